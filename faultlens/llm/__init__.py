"""Training-data operators (documents, vectors, pages, conversations).

Nothing else in the library imports this subpackage.
"""
