"""Training-data operators: dedup, mixing, token files, PII, URL, quality, contamination, licences, language, runs, conversations.

Nothing outside this subpackage imports it; ``corpuslab.llm.queries`` holds its queries and SQL.
"""
