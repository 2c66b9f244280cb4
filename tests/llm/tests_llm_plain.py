"""Plain helpers of the brute-force versions."""

import re


def low_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall("[^\x20\x09-\x0d]+", low)
