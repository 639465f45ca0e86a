"""Token counts by a public tokenizer, as the core has them."""

from inkwell.functions.tokens import DEFAULT, count_tokens, encoding, parts, token_count, vocabulary_file

__all__ = ["DEFAULT", "count_tokens", "encoding", "parts", "token_count", "vocabulary_file"]
