"""Operators for large text corpora and their runnable queries; nothing else in the library imports them."""
