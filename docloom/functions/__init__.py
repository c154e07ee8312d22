"""Column functions: text, numbers, sets. All are built-in expressions unless their docstring says otherwise."""
