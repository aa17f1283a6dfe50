"""quire: document analytics as DataFrame plans.

``sources`` reads files into tables, ``operators`` holds relational layout and
block operators, ``functions`` scalar column functions, ``plans`` the registered
queries with their SQL, ``streaming`` incremental ingestion, and ``llm`` (which
nothing else imports) the training-data operators.
"""
