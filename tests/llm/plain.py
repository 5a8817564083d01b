"""Words in plain Python, for the brute-force versions."""

from thema.llm.text import ALONE, SIGNS


def plain_words(text: str) -> list[str]:
    """Words of a text that is lower-case already, character by character."""
    out, word = [], ""
    for c in text + " ":
        x = ord(c)
        alone = any(a <= x <= b for a, b in ALONE)
        inside = not alone and (c in "0123456789abcdefghijklmnopqrstuvwxyz" or x >= 0x80 and not any(a <= x <= b for a, b in SIGNS))
        if not inside and word:
            out.append(word)
            word = ""
        word += c if inside else ""
        if alone:
            out.append(c)
    return out
