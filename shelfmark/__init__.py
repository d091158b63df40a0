"""Catalogue analytics over large asset libraries, written as lazy Spark plans."""
