"""Column functions: integer-list codecs, key encodings, stemming, tokens."""
