"""Operators that prepare text for training: one module per problem.

Nothing outside this package imports it; deleting it leaves the rest of the
library whole.
"""
