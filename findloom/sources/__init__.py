"""Inputs and outputs: tables, text files, markup, office files, XML and JSON."""
