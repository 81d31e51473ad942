"""The formula language: lexer, parser, compilers."""
