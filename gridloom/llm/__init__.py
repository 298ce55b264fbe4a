"""Training-data operators: ten text and vector operators that stand apart from the grid library.

Nothing outside this subpackage imports it; ``gridloom.llm.registry`` lists its queries.
"""
