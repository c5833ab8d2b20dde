"""Column expressions: names, dates, format-aware equality, mainframe codecs."""
