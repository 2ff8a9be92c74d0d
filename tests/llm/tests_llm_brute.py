"""The pipeline's first four stages in plain Python, for a few small documents."""

import re


def _kmers(text):
    words = [w for w in (re.sub(r"^\W+|\W+$", "", x.lower()) for x in text.split()) if w]
    if len(words) < 5:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def brute_pipeline(rows):
    docs = {d: t for d, t, *_ in rows if t and re.search(r"[^\W\d_]", t)}
    # near copies: Jaccard similarity of runs of five words, 0.8; the first of a class stays
    ids, label = sorted(docs), {}
    for d in ids:
        a = set(_kmers(docs[d]))
        same = next((e for e in ids if e < d and (docs[e] == docs[d] or len(a & set(_kmers(docs[e]))) >= 0.8 * len(a | set(_kmers(docs[e]))))), None)
        label[d] = d if same is None else label[same]
    docs = {d: docs[d] for d in ids if label[d] == d}
    seen, out = {}, {}
    for d in sorted(docs):
        raw = docs[d].encode()
        for i in range(len(raw) - 99):
            seen.setdefault(raw[i : i + 100], (d, i))
    for d in sorted(docs):
        raw = docs[d].encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if seen[raw[i : i + 100]] != (d, i):
                gone[i : i + 100] = b"\1" * 100
        out[d] = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
    return {d: re.sub(r'(token = ")[0-9a-f]{40}(")', r"\1<SECRET>\2", t) for d, t in out.items()}
