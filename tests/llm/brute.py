"""Plain versions of the operators, for small inputs."""

import hashlib


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def near_duplicates(rows, n, percent):
    sets, union = {}, Union()
    for i, t, *_ in rows:
        sets[i] = shingle_set(t, n)
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                union.join(a, b)
    return {i: (len(sets[i]), union.find(i)) for i in ids}


def repeated_strings(rows, length):
    seen, out = set(), []
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeated_lines(rows, size=8, similarity=0.8):
    lines = [(i, k, line) for i, t, *_ in rows for k, line in enumerate((t or "").split("\n")) if line.strip(" \t\x0b\x0c\r")]
    texts, union = sorted({line for *_, line in lines}), Union()
    sets = {x: {x[k : k + size] for k in range(max(1, len(x) - size + 1))} for x in texts}
    for x in texts:
        for y in texts:
            if x < y and len(sets[x] & sets[y]) >= similarity * len(sets[x] | sets[y]):
                union.join(x, y)
    first, gone = {}, {}
    for i, k, line in sorted(lines):
        c = union.find(line)
        if first.setdefault(c, (i, k)) != (i, k):
            gone.setdefault(i, set()).add(k)
    return {i: sorted(k) for i, k in gone.items()}
