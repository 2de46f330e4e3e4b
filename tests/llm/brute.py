"""Plain restatements of the operators' definitions, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def shingles(t):
    w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_duplicates(docs, percent=85):
    """{doc_id: (n_shingles, component)} of [(doc_id, text)] by all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    r, s = root(i), root(j)
                    up[max(r, s)] = min(r, s)
    return {i: (len(sets[i]), root(i)) for i in ids}


def secrets(t):
    t, out = t or "", []
    p = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    out += [("assign", *m.span()) for m in p.finditer(t) if len(m.group(2)) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(t):
    t, out = t or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def quality(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)


def chat(turns):
    """(n_turns, turns_sha256, loss_chars, loss_sha256) of [(role, text)] in order."""
    said = "".join(f"{r}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), h(said), len(loss), h(loss)


def embedding_links(rows, threshold=0.98):
    """{position: (n_links, component)} of [(vec_id, vector, label)] by all pairs."""
    import math

    def fine(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    up, links = {r[0]: r[0] for r in rows}, [0] * n

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            (a, x, p), (b, y, q) = rows[i], rows[j]
            if p is None or p != q or not fine(x) or not fine(y) or len(x) != len(y):
                continue
            dot = sum(s * t for s, t in zip(x, y))  # noqa: B905
            if dot / math.sqrt(sum(s * s for s in x)) / math.sqrt(sum(t * t for t in y)) >= threshold:
                links[i] += 1
                links[j] += 1
                r, s = root(a), root(b)
                up[max(r, s)] = min(r, s)
    return [(links[i], root(rows[i][0])) for i in range(n)]


def toxicity(lex, text):
    """Raw score of a text by looking back from each word of each clause; lex gives stems, weights and factors."""
    from alertloom.llm import toxicity as tox

    aim, negated, reported = (lex.factors[b] for b in (tox.AIMED, tox.NEGATED, tox.REPORTED))
    found = {}
    for clause in re.split(r"[.!?;\n]", (text or "").lower()):
        w = re.findall(r"[^\W\d_]+", clause)
        symbols = [lex.weigh(x) for x in w]
        kind = [s for s, *_ in symbols]
        last = None
        for i, (symbol, name, weight) in enumerate(symbols):
            f = (negated if tox.NEGATION in kind[max(0, i - 2) : i] else 1) * (reported if tox.REPORT in kind[:i] else 1)
            if symbol == tox.INSULT:
                found.setdefault(name, []).append(weight * f * (aim if tox.TARGET in kind[max(0, i - 4) : i] else 1))
            elif symbol == tox.THREAT:
                own = lex.stems.get(name, 0)
                if own:
                    found.setdefault(name, []).append(own * f)
                last = (i, name, (weight - own) * f)
            elif symbol == tox.TARGET and last and i - last[0] <= 4:
                if last[2] > 0:
                    found.setdefault(name + last[1], []).append(0)
                    found.setdefault((last[1],), []).append(last[2])
                last = None
    return sum(sum(sorted(v, reverse=True)[:3]) for v in found.values())
