"""The markup language itself, in plain Python: one document in, a tree, a text or a list of findings out.

Nothing here knows Spark; ``loomtext.operators.documents`` runs it over DataFrames.
"""
