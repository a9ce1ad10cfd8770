"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns; brute-force forms."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ["node", "sigs", "_spans", "_doc", "_found", "_merged", "_cleaned", "h1", "block", "length", "slot", "words"]

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rnd, n):
    out = []
    for k in range(n):
        out.append(rnd.choice(WORDS) + str(rnd.randint(0, 60)) if rnd.random() < 0.5 else rnd.choice(WORDS))
        if k % 9 == 8:
            out[-1] += "."
        if k % 31 == 30:
            out[-1] += "\n"
    return " ".join(out).replace("\n ", "\n")


def documents(seed=3):
    """(doc_id, text, lang, source, n_chars) rows."""
    rnd = random.Random(seed)
    texts = [prose(rnd, rnd.choice([3, 12, 60, 200, 400])) for _ in range(60)]
    texts += [None, "", " \n\t ", "one", "two words", "Ünïcödé 漢字 🙂 text\u00a0here", "a\x0bb\x1cc  d   e\r\n f "]
    base = prose(rnd, 300)
    for k in range(25):  # near copies
        words = base.split(" ")
        for _ in range(k // 2):
            words[rnd.randrange(len(words))] = "edit" + str(rnd.randint(0, 999))
        texts.append(" ".join(words))
    texts += [base] * 12 + ["short text of six words here"] * 5 + ["Short Text of six words HERE"] * 2
    shared = prose(rnd, 70)
    texts += [prose(rnd, 40) + ". " + shared + ". " + prose(rnd, 30) for _ in range(6)]
    texts += [
        "Write to a.b@c-d.example.com, x@y, u@v.w_z@q.r or call +1 (234) 555-7890 now; 10.0.0.255 or 256.1.1.1 or 1.2.3.4.5",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111, 12345678901234567890123",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and serial 20240101123456',
        "a@b.c.d.e.f.g " * 40 + "1 " * 3000,
        "\x01\x03 mail\x01 me@there.org \x04 +4912345678901\x05",
        "x" * 5000,
        " ".join(["very"] * 4000),
        prose(rnd, 12000),
    ]
    rows = [(k, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows + rows[5:8]  # repeated rows


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def components_of(nodes, links):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def shingles(text, n):
    w = words_of(lower_ascii(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if len(w) >= n else frozenset([tuple(w)])


def jaccard_classes(rows, n, least):
    sets = {r[0]: shingles(r[1], n) for r in rows}
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= least * len(s | t):
                links.append((a, b))
    comp = components_of(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text):
    """kind -> spans, by the patterns as they are stated."""
    text = text or ""
    found = {"email": [], "ip": [], "card": [], "phone": []}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            found["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found["phone"].append(m.span())
    return found
