"""Column functions: the two vocabularies, predicates, peaks, order."""
