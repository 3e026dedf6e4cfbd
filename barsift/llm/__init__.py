"""Training-data operators: one module per operator, plus their registered queries.

Nothing else in the package imports this folder; removing it leaves the
screening engine untouched.
"""
