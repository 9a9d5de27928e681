"""Training-data pipeline operators.

Ten operators over a corpus of documents.  Nothing else in the library imports
this subpackage; ``queries`` registers their contract queries.
"""
