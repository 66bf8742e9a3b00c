"""Every registered query and its SQL counterpart."""

from textloom.registry import answers, classify, retrieval, storage, text

MODULES = (text, retrieval, classify, answers, storage)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
