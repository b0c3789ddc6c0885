"""Plain versions of the operators, for small tables."""

import re
from collections import defaultdict

import xxhash

SEPARATED = re.compile(r"[^\x20\x09-\x0d]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    words = SEPARATED.findall(lowered(text))
    if len(words) < 5:
        return frozenset({tuple(words)} if words else ())
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(rows):
    """(doc_id, text) rows with distinct ids: {doc_id: (n_shingles, component_id)}."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def lines(text):
    return [u for u in re.split(r"(?<=\n)|(?<=[.!?] )", text or "") if u]


def line_hash(line):
    """Spark's xxhash64 of a string, signed."""
    return xxhash.xxh64_intdigest(line.encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest(line.encode(), 42) >> 63 else 0)


def deduplicated(rows, short=20, long=100):
    """(doc_id, text) rows with distinct ids: {doc_id: (text left, lines removed)}."""
    firsts, out = set(), {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        units = lines(text)
        at = [i for i, u in enumerate(units) if u.rstrip(" \t\r\n")]
        bare, gone = [units[i].rstrip(" \t\r\n") for i in at], set()
        hashes = [line_hash(u) for u in bare]
        before = [0, *hashes]
        ends = [k for k, u in enumerate(bare) if len(u) >= short or k == len(bare) - 1 or before[k] == hashes[k] or not (before[k] >> 1 ^ hashes[k]) & 1]
        starts = [0, *(e + 1 for e in ends)]
        spans = []
        for i in range(len(ends) - 1):
            enough = [j for j in range(i + 1, len(ends)) if sum(map(len, bare[starts[i] : ends[j] + 1])) >= 2 * short]
            spans += [(starts[i], ends[enough[0]])] if enough else []
        cuts = {(a, b): tuple(sorted(e - a for e in ends if a <= e < b)) for a, b in spans}
        spans += [(k, k) for k, u in enumerate(bare) if len(u) >= long]
        for a, b in sorted(spans):
            window = (tuple(bare[a : b + 1]), cuts.get((a, b)))
            if window in firsts:
                gone |= set(range(at[a], at[b] + 1))
            firsts.add(window)
        out[d] = ("".join(u for i, u in enumerate(units) if i not in gone), len(gone))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


ENCODINGS = (("[0-9a-fA-F]+", 16), ("([A-Z2-7]+|[a-z2-7]+)=*", 32), ("[A-Z0-9]+|[a-z0-9]+", 36), ("[A-Za-z0-9]+", 62), (".*", 64))


def prose_tests(value):
    """Uniformity, changes of class, and lag-1 correlation of a stretch of prose."""
    n, size = len(value), next(k for pattern, k in ENCODINGS if re.fullmatch(pattern, value))
    uniform = (size * sum(value.count(c) ** 2 for c in set(value)) / n - n - (size - 1)) / (2 * (size - 1) * (1 - 1 / n)) ** 0.5
    classes = [0 if c in "0123456789" else 1 if c.isupper() else 2 if c.islower() else 3 for c in value]
    mean = sum(map(ord, value)) / n
    apart = [ord(c) - mean for c in value]
    serial = abs(sum(a * b for a, b in zip(apart, apart[1:]))) / max(1e-9, sum(a * a for a in apart))
    return {"uniform": uniform, "turns": sum(a != b for a, b in zip(classes, classes[1:])) / (n - 1), "serial": serial}


def prose_model(texts, lengths=(22, 28, 40, 64, 96)):
    """{band: {test: (mean, deviation)}} over all prose, cut into stretches of each length in turn; the last one ends with the text."""
    found = defaultdict(list)
    for text in texts:
        left = "".join(run for run in re.findall("[A-Za-z0-9+/_=-]+", text) if len(run) < 20)
        at, turn, seen = 0, 0, set()
        while at < len(left) and len(left) >= lengths[0]:
            band = turn % len(lengths) if lengths[turn % len(lengths)] <= len(left) else 0
            start = min(at, len(left) - lengths[band])
            found[band].append(prose_tests(left[start : start + lengths[band]]))
            seen |= set(range(start, start + lengths[band]))
            at, turn = at + lengths[turn % len(lengths)], turn + 1
        assert len(seen) in (0, len(left))
    model = {}
    for band in range(len(lengths)):
        rows = found[band] if len(found[band]) >= 30 else [r for rs in found.values() for r in rs]
        model[band] = {}
        for test in ("uniform", "turns", "serial"):
            mean = sum(r[test] for r in rows) / len(rows)
            model[band][test] = (mean, (sum((r[test] - mean) ** 2 for r in rows) / len(rows)) ** 0.5)
    return model


def repeated_passages(rows, words=50):
    """(doc_id, text) rows with distinct ids: {doc_id: numbers of lines in a run that is in an earlier place too}.

    A run has more than ``words`` words, begins and ends with a non-blank line and doesn't overlap the earlier one.
    """
    firsts, gone = {}, defaultdict(set)
    for d, text in sorted(rows, key=lambda r: r[0]):
        bare = [u.rstrip(" \t\r\n") for u in lines(text)]
        for a in range(len(bare)):
            for b in range(a, len(bare)):
                run = tuple(bare[a : b + 1])
                if run[0] and run[-1] and sum(len(u.split()) for u in run) > words:
                    first, at = firsts.setdefault(run, (d, a))
                    if first != d or at + len(run) <= a:
                        gone[d] |= set(range(a, b + 1))
    return {d: gone[d] for d, _ in rows}
