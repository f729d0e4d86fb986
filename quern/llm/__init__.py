"""Training-data operators: cleaning, deduplication, labelling, tokenising and mixing of documents.

Nothing outside this package imports it; its queries are listed in :mod:`quern.llm.queries`.
"""
