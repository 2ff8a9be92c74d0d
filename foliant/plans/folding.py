"""How SQL folds text: the letters of each plain one, spelled out, so that nothing is taken from the functions that are held against it."""

from __future__ import annotations

# Letters with accents by the plain letter that they are searched as.
LETTERS = {
    "a": "àáâãäåāăą", "c": "çćĉċč", "d": "ďđ", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥħ", "i": "ìíîïĩīĭįı", "j": "ĵ", "k": "ķ", "l": "ĺļľŀł", "n": "ñńņňŉ",
    "o": "òóôõöøōŏő", "r": "ŕŗř", "s": "śŝşšș", "t": "ţťŧț", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}
_FROM = "".join(LETTERS.values())
_TO = "".join(k * len(v) for k, v in LETTERS.items())


def folded(sql: str) -> str:
    return f"translate(translate(lower({sql}), '{_FROM}', '{_TO}'), '’‘“”', chr(39) || chr(39) || chr(34) || chr(34))"
