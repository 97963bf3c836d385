"""End-to-end composition of the operators."""
