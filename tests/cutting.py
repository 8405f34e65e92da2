"""Plain versions of text functions, to compare with."""

from lorespark.functions.text import count_tokens


def first_tokens(text: str, most: int) -> str:
    """The longest prefix within a token budget, by bisection over characters; for texts of one overlong line."""
    low, high = 0, len(text)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if count_tokens(text[:mid]) <= most else (low, mid - 1)
    return text[:low]
