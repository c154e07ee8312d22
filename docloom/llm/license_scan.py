"""Licence families of paragraphs, in DataFrame expressions.

A multinomial logistic regression over words and word pairs is fitted on the driver to fixed texts: notices
that name a licence, the paragraphs of licences' own texts, windows of these, and, as the class
`unknown`, other licences and sentences that only sound like notices. A temperature fitted on damaged
copies, and on wordings and licences that training never saw, calibrates its probabilities. Each
prediction is confirmed by how much of the nearest text of its family the paragraph holds.

Every paragraph is decided by the classifier. Its weights say which ones need no sum: where no word
of any gram that speaks for a family occurs, `unknown` wins. These words (`Classifier.anchors`) are
looked up first, so the sums are made for few paragraphs.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import materialize, table

UNKNOWN = "unknown"

#: Names that notices give the families; the key is the family's identifier.
NAMES = {
    "MIT": ("the MIT License", "the MIT licence", "MIT", "the mit license"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0", "Apache License v2"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU GPL version 2", "GPLv2", "GPL 2.0"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU GPL version 3", "GPLv3", "GPL 3.0"),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "the GNU LGPL version 2.1", "LGPLv2.1", "LGPL 2.1"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "the GNU LGPL version 3", "LGPLv3", "the GNU Lesser General Public License"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "the GNU AGPL version 3", "AGPLv3", "AGPL 3.0"),
    "BSD": ("the BSD License", "the 3-clause BSD License", "the BSD 2-clause licence", "BSD"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the MPL 2.0", "MPLv2", "the Mozilla Public License"),
    "ISC": ("the ISC License", "the ISC licence", "ISC"),
    "CC-BY": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "CC-BY 3.0", "a Creative Commons Attribution license"),
    "CC-BY-SA": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA 3.0", "a Creative Commons Attribution-ShareAlike license"),
    "CC-BY-NC": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC 3.0", "a Creative Commons Attribution-NonCommercial license"),
    "CC-BY-ND": ("CC BY-ND 4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND 3.0", "a Creative Commons Attribution-NoDerivatives license"),
    "CC0": ("CC0 1.0", "the CC0 1.0 Universal public domain dedication", "CC0", "Creative Commons Zero"),
    "Unlicense": ("the Unlicense", "the Unlicense, into the public domain", "Unlicense"),
}
OPENINGS = (
    "{}", "Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This software is distributed under the terms of {}.", "Published under {}; see the file LICENSE.", "Copyright of the authors. Available under {}.",
    "You may use this code under {}.", "This program is licensed under {}.", "License: {}", "Lizenziert unter {}.", "Lizenz: {}", "Sous licence {}.", "Licenza {}", "Licencia {}", "{} or later", "This library is free software under {}.",
)
#: Wordings that calibration has and training has not.
OTHER_OPENINGS = ("Code in this folder: {}", "Everything here is covered by {}.", "{} applies to all files below.", "The project uses {} throughout, with exceptions named in its sources.", "Veröffentlicht unter {}.", "Anyone may copy it as {} allows.")

#: Paragraphs of the licences' own texts and of the notices they ask for.
TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    "LGPL-3.0": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "CC-BY": ("You are free to share and adapt the material for any purpose, even commercially, under the Creative Commons Attribution terms: you must give appropriate credit, provide a link to the license, and indicate if changes were made.",),
    "CC-BY-SA": ("Under the Creative Commons Attribution-ShareAlike terms, if you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",),
    "CC-BY-NC": ("Under the Creative Commons Attribution-NonCommercial terms, you may not use the material for commercial purposes.",),
    "CC-BY-ND": ("Under the Creative Commons Attribution-NoDerivatives terms, if you remix, transform, or build upon the material, you may not distribute the modified material.",),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal public domain dedication.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.",
    ),
}
#: Other licences by name, which are unknown; the last ones are for calibration only.
OTHER_NAMES = (
    "the European Union Public Licence, version 1.2", "the Common Development and Distribution License 1.0", "the SIL Open Font License, Version 1.1", "the Open Software License 3.0", "the Academic Free License, version 3.0", "the PostgreSQL License",
    "the Python Software Foundation License, version 2", "the Ruby License", "the PHP License, version 3.01", "the Common Public License, version 1.0", "the IBM Public License", "the Microsoft Public License", "the Q Public License, version 1.0",
    "the Server Side Public License, version 1", "the Business Source License 1.1", "the Elastic License 2.0", "the Open Database License", "the Sleepycat License", "the Example Licence 2.0", "the Acme Public License, version 3",
    "the Acme Public License 2.0", "the Acme Software License, Version 2.0", "a proprietary license", "the Lucent Public License 1.02", "the Sun Public License, version 1.0", "the Reciprocal Public License 1.5", "version 2.0 of our licence", "our own terms, version 3",
    "the Do What The Fuck You Want To Public License, version 2", "the Beerware License", "the JSON License", "the X License, version 2.1", "the Public Licence of the town", "a free license", "the General License, version 3", "the Lesser License, version 2.1",
)
HELD_OUT_NAMES = ("the Netscape Public License, version 1.1", "the Zope Public License 2.1", "the Nokia Open Source License", "the Apple Public Source License 2.0", "the OpenSSL License", "the Frameworx License 1.0", "the Motosoto License", "the Ricoh Source Code Public License")
#: Paragraphs of other licences.
OTHER_TEXTS = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "This license grants you a non-exclusive, non-transferable right to install one copy of the program on a single computer.", "You may not reverse engineer, decompile, or disassemble the product, and you may not rent or lease it.",
    "By installing the software you accept the terms of this agreement; if you do not accept them, return the software.", "The Font Software may be sold as part of a larger software package but no copy of the fonts may be sold by itself.",
    "Any Contributor may publish new versions of this Agreement; the Program may always be distributed subject to the version under which it was received.", "The Software shall be used for Good, not Evil.",
    "The licensee shall pay the fee within thirty days of the invoice, without deduction.", "All disputes arising from this agreement shall be settled by the courts of the seller's town.",
)
#: What only sounds like a notice.
OTHERS = (
    "You need a driving licence to hire a car.", "The license plate was missing.", "Her licence to practise was renewed in 2020.", "Licensed under a commercial agreement with the vendor.", "Licensed under patent number 4.0.", "This work is licensed under contract.",
    "All rights reserved.", "Copyright 2019 by the publisher. All rights reserved.", "The film was released under pressure.", "Version 2.0 of the software was released in May.", "The software is distributed under seal.", "No licence is granted.",
    "This program is licensed to one user only.", "Released under a different title in version 3.", "The licence fee is due yearly.", "Published under a pen name.", "A fishing license is valid for one season.", "The terms of the licence are confidential.",
    "The work is licensed under the Example Licence.", "This software is distributed under the terms of a signed contract.", "Permission to enter is hereby granted.", "The public library is open to any person.", "The general public may use the hall free of charge.",
    "Available under the counter.", "Licensed under section 3 of the act.", "He was licensed as a pilot.", "Licensed premises close at ten.", "Copyright law applies.", "The publisher holds the copyright of this work.", "Use of this code is forbidden without a licence.",
    "Er kommt mit uns nach Hause und spricht mit der Frau.", "Mit der Zeit wurde es mit ihm besser.", "Die Lizenz wurde mit Zustimmung erteilt.", "The creative director praised the commons.", "The attribution of the painting is disputed.", "Apache helicopters flew over the base.",
    "The Apache people of the plains.", "Mozilla released a new version of its browser.", "The gnu is an animal of the savannah.", "GNU tools were used to build it.", "MIT is a university in Cambridge.", "She studied at MIT and later taught there.", "The BSD operating systems descend from Unix.",
    "The ISC conference was held in May.", "He sent a copy to his boss, CC to the board.", "CC the message to all of them by email.", "The binary was compiled from source.", "The conditions of sale are printed overleaf.", "Redistribution of income is a matter of policy.",
    "The warranty of the car ends after two years.", "The work was dedicated to the memory of his mother.", "The software of the phone was updated to version 3.", "Modify the file and copy it to the server.", "The general was seen in public without his medals.", "The Free Software Foundation was founded in 1985.",
    "The author disclaims nothing that he has written.", "Parts of the estate passed into the public domain of the crown.", "Commercial use of the hall needs permission of the council.", "Share the road.", "By and large the plan was a success.", "SA and NC are abbreviations of regions.",
    "The document is available under the following address.", "Version 3 or later of the driver is required.", "See the file LICENSE for details.", "Terms and conditions apply.", "The lesser evil is the public choice.", "Affero is a name.", "Attribution theory is a branch of psychology.",
)

#: Longer words of any text, which say nothing of a licence unless beside one that does.
COMMON = frozenset("about above after along always being could either every first found further great group having helped hours house however known large later limited made means might named needs nothing often other others otherwise place possible related should since small special state still their there these things think those three time times under until using water whether which while whole whose without world would write written years unter".split())
#: Short words that name families.
SHORT_NAMES = frozenset("isc bsd gnu gpl gplv lgpl lgplv agpl agplv mpl mplv cc".split())
TOKEN = r"[A-Za-z]+|[0-9]+(?:\.[0-9]+)*"
#: Words of two to five capitals keep them: MIT is no German word. Words beside `v` and a number are one with them, as in GPLv3.
CAPITALS = "^[A-Z]{2,5}$"
#: Where a paragraph ends: a blank line, or the end of a line that closes a sentence.
PARAGRAPH = r"(?<=[.!?:;])[ \t\r]*\n\s*|\n[ \t\r]*\n\s*"
#: Least probability of a family, and least weight of a text that a paragraph must hold to be confirmed.
LEAST, CONFIRMED = 0.5, 0.6


def notices() -> list[tuple[str, str]]:
    out = [(family, opening.format(name)) for family, names in NAMES.items() for name in names for opening in OPENINGS]
    return out + [(family, f"SPDX-License-Identifier: {family}") for family in NAMES] + [(family, t) for family, texts in TEXTS.items() for t in texts]


def says(word: str) -> bool:
    """Whether a word may speak for a family: capitals, the short names, and longer words that are not COMMON."""
    return bool(re.match(CAPITALS, word)) or word in SHORT_NAMES or len(word) >= 5 and word.isalpha() and word not in COMMON


def grams(text: str) -> list[str]:
    """Distinct words, and pairs of neighbours; grams_of does the same to a column."""
    words = [w if re.match(CAPITALS, w) else w.lower() for w in re.findall(TOKEN, text)]
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]))


def grams_of(text: Column) -> Column:
    words = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: F.when(w.rlike(CAPITALS), w).otherwise(F.lower(w)))

    def both(words):
        rest = F.greatest(F.size(words) - 1, F.lit(0))
        return F.array_distinct(F.concat(words, F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: F.concat_ws(" ", a, b))))

    return F.get(F.transform(F.array(words), both), F.lit(0))


def windows(rows: list[tuple[str, str]], rng: random.Random, each: int) -> list[tuple[str, str]]:
    """Runs of words of the longer texts, as wrapped or cut-off copies have them."""
    out = []
    for family, text in rows:
        words = text.split()
        if len(words) >= 16:
            for _ in range(each):
                n = rng.randint(10, len(words) - 2)
                at = rng.randint(0, len(words) - n)
                out.append((family, " ".join(words[at : at + n])))
    return out


def damaged(rows: list[tuple[str, str]], rng: random.Random, lost: float) -> list[tuple[str, str]]:
    out = []
    for family, text in rows:
        words = [w for w in text.split() if rng.random() >= lost]
        if words:
            out.append((family, " ".join(words)))
    return out


def examples() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(training, calibration) rows of a class and a text."""
    rng = random.Random(5)
    others = [(UNKNOWN, opening.format(name)) for name in OTHER_NAMES for opening in OPENINGS] + [(UNKNOWN, t) for t in (*OTHER_TEXTS, *OTHERS, *map(str.upper, OTHERS))]
    bodies = [(f, t) for f, texts in TEXTS.items() for t in texts] + [(UNKNOWN, t) for t in OTHER_TEXTS]
    plain = sorted({w for _, t in [*bodies, *others] for w in t.split()})
    salad = [(UNKNOWN, " ".join(rng.choice(plain) for _ in range(rng.randint(10, 60)))) for _ in range(150)]  # words alone say little
    own = [x for x in bodies if x[0] != UNKNOWN]
    train = [*notices(), *own * 3, *windows(own, rng, 8), *others, *salad]  # whole paragraphs weigh as their windows do
    new = [(f, o.format(n)) for f, names in NAMES.items() for n in names for o in OTHER_OPENINGS] + [(UNKNOWN, o.format(n)) for n in HELD_OUT_NAMES for o in (*OPENINGS, *OTHER_OPENINGS)]
    new += [(UNKNOWN, o.format(n)) for n in OTHER_NAMES for o in OTHER_OPENINGS]
    return train, [*damaged(new, rng, 0.1), *damaged(windows(bodies, rng, 6), rng, 0.25), *damaged([(UNKNOWN, t) for t in OTHERS] * 2, rng, 0.2)]


@dataclass
class Classifier:
    classes: list[str]
    grams: list[str]
    weights: np.ndarray  # grams by classes
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        at = {g: i for i, g in enumerate(self.grams)}
        return self.bias + sum((self.weights[at[g]] for g in grams(text) if g in at), np.zeros(len(self.classes)))

    def probabilities(self, text: str) -> np.ndarray:
        x = self.logits(text) / self.temperature
        e = np.exp(x - x.max())
        return e / e.sum()

    def anchors(self) -> tuple[list[str], list[str]]:
        """Words, lower-cased and in capitals, of which each paragraph that a family wins holds one.

        A family must overtake `unknown`, whose bias is not below its own, by a gram that weighs more for it.
        """
        lead = self.weights - self.weights[:, [self.classes.index(UNKNOWN)]]
        speaks = [g.split(" ") for g, x in zip(self.grams, lead.max(1)) if x > 0]
        count: dict[str, int] = {}
        for t in (*OTHERS, *OTHER_TEXTS):
            for g in grams(t):
                count[g] = count.get(g, 0) + 1
        chosen: set[str] = set()
        for words in sorted(speaks, key=lambda g: (len(g), g)):
            if not chosen.intersection(words):
                chosen.add(min(filter(says, words), key=lambda w: (count.get(w, 0), -len(w), w)))
        return sorted(w for w in chosen if w.islower()), sorted(w for w in chosen if w.isupper())


@cache
def train(penalty: float = 6e-5, ridge: float = 2e-4, rounds: int = 150) -> Classifier:
    """Fitted by accelerated gradient steps with L1 and L2 penalties; families weigh alike, unknown as all of them together.

    Grams are used if a word of theirs says something and two training texts hold them.
    """
    rows, calibration = examples()
    classes = [*NAMES, UNKNOWN]
    held: dict[str, int] = {}
    for _, t in rows:
        for g in grams(t):
            held[g] = held.get(g, 0) + 1
    vocabulary = sorted(g for g, n in held.items() if n > 1 and any(map(says, g.split(" "))))
    at = {g: i for i, g in enumerate(vocabulary)}

    def matrix(of):
        x = np.zeros((len(of), len(vocabulary)), np.float32)
        for i, (_, t) in enumerate(of):
            x[i, [at[g] for g in grams(t) if g in at]] = 1
        return x, np.array([classes.index(c) for c, _ in of])

    x, y = matrix(rows)
    share = np.bincount(y, minlength=len(classes))
    scale = (1 / share)[y] * np.where(y == len(classes) - 1, len(NAMES), 1)
    scale = (scale / scale.sum()).astype(np.float32)[:, None]
    goal = np.eye(len(classes), dtype=np.float32)[y]
    widest = np.ones(len(vocabulary), np.float32)
    for _ in range(20):  # the largest curvature, by power iteration
        widest = x.T @ (scale[:, 0] * (x @ widest))
        length = float(np.linalg.norm(widest))
        widest /= length
    step = 1 / (length + 1)
    w, b = np.zeros((len(vocabulary), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    v, vb, t = w, b, 1.0
    for _ in range(rounds):
        z = x @ v + vb
        p = np.exp(z - z.max(1, keepdims=True))
        off = (p / p.sum(1, keepdims=True) - goal) * scale
        new = v - step * (x.T @ off + ridge * v)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = vb - step * off.sum(0)
        new_b[:-1] = np.minimum(new_b[:-1], new_b[-1])  # without any gram, unknown wins
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / later * (new - w), new_b + (t - 1) / later * (new_b - b)
        w, b, t = new, new_b, later
    cx, cy = matrix(calibration)
    z = (cx @ w + b).astype(np.float64)

    def loss(temperature):
        q = z / temperature
        q = q - q.max(1, keepdims=True)
        return -(q[np.arange(len(q)), cy] - np.log(np.exp(q).sum(1))).mean()

    temperature = min(TEMPERATURES, key=loss)
    kept = np.flatnonzero(np.abs(w).max(1) > 1e-6)
    return Classifier(classes, [vocabulary[k] for k in kept], w[kept].astype(float), b.astype(float), float(temperature))


#: Temperatures that calibration chooses from.
TEMPERATURES = np.geomspace(0.05, 5, 60)


@cache
def templates() -> list[tuple[str, int, list[str], list[float]]]:
    """(family, number, grams, weights that sum to 1): a gram counts by how few families have it."""
    rows = notices()
    families: dict[str, set[str]] = {}
    for f, t in rows:
        for g in grams(t):
            families.setdefault(g, set()).add(f)
    out = []
    for i, (f, t) in enumerate(rows):
        found = grams(t)
        weight = [float(np.log((len(NAMES) + 1) / len(families[g]))) for g in found]
        out.append((f, i, found, [x / sum(weight) for x in weight]))
    return out


def scan_paragraphs(docs: DataFrame, text: str = "text", least: float = LEAST, confirmed: float = CONFIRMED) -> DataFrame:
    """A row for each paragraph that holds a word which may speak for a family: the columns of docs but the text, and
    paragraph (from 0), family, probability, template_similarity and confirmed. All others are `unknown`.

    A paragraph ends at a blank line, or where a line ends a sentence; it may be wrapped. family is
    `unknown` below `least` or if that class is likeliest (of ties, the first in NAMES); template_similarity
    is the largest weight of a text of the family that the paragraph holds, null for unknown; confirmed
    where that reaches `confirmed`. Null and empty texts have no such paragraphs; long texts count whole; repeated
    rows give rows each; an empty table stays empty. Columns of docs with the names of results are dropped.
    """
    model = train()
    spark = docs.sparkSession
    docs = docs.drop(*(c for c in ("paragraph", "family", "probability", "template_similarity", "confirmed") if c != text))
    kept = [c for c in docs.columns if c != text]
    lower, capitals = model.anchors()
    may_speak = lambda t: F.arrays_overlap(F.split(F.lower(t), r"[^a-z]+"), F.array(*map(F.lit, lower))) | t.rlike(rf"(?<![A-Za-z])({'|'.join(capitals)})(?![A-Za-z])")
    units = docs.where(may_speak(F.col(text))).select(*kept, F.posexplode(F.split(text, PARAGRAPH)).alias("paragraph", "_unit")).where(may_speak(F.col("_unit")))
    units = materialize(units.withColumn("_grams", grams_of(F.col("_unit"))).drop("_unit"), "paragraphs", "_row")
    names = [f"_c{k}" for k in range(len(model.classes))]
    # as many rows as the fixed texts have grams, whatever the corpus
    weights = spark.createDataFrame([(g, *map(float, w)) for g, w in zip(model.grams, model.weights)], "_gram string, " + ", ".join(f"{n} double" for n in names))
    terms = units.select("_row", F.explode("_grams").alias("_gram")).join(F.broadcast(weights), "_gram")
    sums = terms.groupBy("_row").agg(*(F.sum(n).alias(n) for n in names))
    scored = units.join(sums, "_row", "left")
    logits = [(F.coalesce(n, F.lit(0.0)) + F.lit(float(b))) / F.lit(model.temperature) for n, b in zip(names, model.bias)]
    scored = scored.withColumn("_z", F.array(*logits)).drop(*names).withColumn("_top", F.array_max("_z"))
    scored = scored.withColumn("probability", F.lit(1.0) / F.aggregate("_z", F.lit(0.0), lambda s, z: s + F.exp(z - F.col("_top"))))
    likeliest = F.element_at(F.array(*map(F.lit, model.classes)), F.array_position("_z", F.col("_top")).cast("int"))
    scored = scored.withColumn("family", F.when(F.col("probability") >= least, likeliest).otherwise(F.lit(UNKNOWN))).drop("_z", "_top")
    fixed = spark.createDataFrame([(f, i, g, x) for f, i, gs, xs in templates() for g, x in zip(gs, xs)], "family string, _template int, _gram string, _weight double")
    near = scored.select("_row", "family", F.explode("_grams").alias("_gram")).join(F.broadcast(fixed), ["family", "_gram"])
    near = near.groupBy("_row", "_template").agg(F.sum("_weight").alias("_held")).groupBy("_row").agg(F.max("_held").alias("_held"))
    out = scored.join(near, "_row", "left").withColumn("template_similarity", F.when(F.col("family") != UNKNOWN, F.round(F.coalesce("_held", F.lit(0.0)), 9)))
    out = out.withColumn("confirmed", F.coalesce(F.col("template_similarity") >= confirmed, F.lit(False)))
    return out.select(*kept, "paragraph", "family", "probability", "template_similarity", "confirmed")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of documents that may be a notice."""
    return scan_paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "paragraph", "family", F.round("probability", 9).alias("probability"), "template_similarity", "confirmed")


QUERIES = {"op7_license_scan": op7_license_scan}
ORACLES: dict[str, str] = {}
