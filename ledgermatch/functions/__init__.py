from .keys import hash_key, money_key, text_key
from .oracle import blank_to_null, concat_text, minus_days, number_text, plus_days
from .tokens import invoice_token_flag, token_pattern

__all__ = [
    "blank_to_null",
    "concat_text",
    "invoice_token_flag",
    "minus_days",
    "money_key",
    "number_text",
    "plus_days",
    "hash_key",
    "text_key",
    "token_pattern",
]
