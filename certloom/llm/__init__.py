"""Training-corpus operators; their queries are collected in ``certloom.llm.registry``."""
