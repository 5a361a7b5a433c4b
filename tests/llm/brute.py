"""Plain-Python versions that the operators are held against."""

import hashlib
import re

sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    back = [int(c) for c in reversed(d)]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x * 2 > 9) for i, x in enumerate(back)) % 10 == 0


def pii(text):
    text, out = text or "", {}
    for kind, p in PII.items():
        out[kind] = []
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out[kind].append((m.start(), m.end()))
    joined = ",".join(f"{k}:{a}:{b}" for k in PII for a, b in out[k])
    return {k: len(v) for k, v in out.items()}, sha(joined)


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(docs, items, n=13):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1):
            if k:
                windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    widths = {len(x) for x in windows}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in widths:
            for i in range(len(w) - k + 1):
                if (got := windows.get(tuple(w[i : i + k]))):
                    hit |= set(range(i, i + k))
                    found |= got
        yield doc_id, len(w), len(hit), len(found), sha(",".join(sorted(str(x) for x in found))), bool(hit) and 20 * len(hit) >= len(w)
