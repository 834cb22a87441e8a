"""The query language: lexer, parser and the compiler from its syntax tree to DataFrames."""
