"""Operators for language-model training data. Nothing outside this subpackage imports it."""

#: Modules with the queries of this subpackage and their SQL.
MODULES = ["weftline.llm.duplicate_queries", "weftline.llm.token_queries", "weftline.llm.text_queries"]
