"""Small parsers of option strings."""

from __future__ import annotations


def number_or_rate(text: str) -> tuple[float | None, float | None]:
    """(absolute, rate): "25%" and numbers below 1 are rates, others absolute."""
    text = text.strip()
    if text.endswith("%"):
        return None, float(text[:-1]) / 100
    value = float(text)
    return (None, value) if value < 1 else (value, None)


def key_values(text: str, separators: str = ";,") -> list[tuple[str, float]]:
    """Pairs of "a:1;b:2"; a bare number has the key "", a bare name the value 1."""
    for s in separators[1:]:
        text = text.replace(s, separators[0])
    out = []
    for part in filter(None, (p.strip() for p in text.split(separators[0]))):
        key, colon, value = part.rpartition(":")
        if colon:
            out.append((key.strip(), float(value)))
        else:
            try:
                out.append(("", float(part)))
            except ValueError:
                out.append((part, 1.0))
    return out


def topic_groups(text: str) -> dict[str, list[str]]:
    """Topic names by group: "obj:10;background:2" gives obj_0 .. obj_9 and background_0, background_1;
    a group of one keeps its bare name, a bare number is the group "topic"."""
    out: dict[str, list[str]] = {}
    for key, value in key_values(text):
        name, n = key or "topic", int(value)
        out[name] = [name] if n == 1 else [f"{name}_{i}" for i in range(n)]
    return out
