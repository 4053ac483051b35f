"""Whole analyses made of the operators, over the input schemas in FIXTURES.md."""
