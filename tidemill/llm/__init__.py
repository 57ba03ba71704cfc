"""Operations for preparing training text, each a Spark job over a table of documents.

Nothing outside this folder imports it.
"""
