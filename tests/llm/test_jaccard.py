import random

from keyroll.llm import jaccard_join as jj
from tests.llm.conftest import prose


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d if d is not None else -1, len(sets[i]), -1 if least.get(find(i)) is None else least[find(i)])
                  for i, (d, _) in enumerate(rows))


def edited(rng, text, share):
    return " ".join(prose(rng, 1) + "x" if rng.random() < share else w for w in text.split())


def corpus(seed):
    rng = random.Random(seed)
    passage = prose(rng, 60)
    rows = [prose(rng, rng.randint(1, 300)) for _ in range(40)]
    # Near copies of several strengths, chains of small edits, shared passages.
    for k in range(6):
        text = prose(rng, rng.randint(30, 200))
        rows += [text, text.upper()] + [edited(rng, text, s) for s in (0.01, 0.02, 0.03, 0.04, 0.06) for _ in range(4)]
        chain = text
        for _ in range(6):
            chain = edited(rng, chain, 0.012)
            rows.append(chain)
    rows += [f"{prose(rng, 40)} {passage} {prose(rng, rng.randint(1, 40))}" for _ in range(25)] + [passage] * 3
    rows += [None, "", " \n", "a", "A", "a b c d", "a b  c D", "a b c d e", "a b c d e f", "é É", "É É"]
    rng.shuffle(rows)
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


def run(frame):
    return sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1)
                  for r in jj.components_of(frame).collect())


def test_components_match_brute_force(docs):
    rows = corpus(1)
    assert run(docs(rows)) == brute(rows)


def test_null_and_repeated_ids(docs):
    rng = random.Random(9)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(None, a), (7, a), (3, a), (5, b), (5, prose(rng, 60)), (None, b), (None, "only here once"), (8, None), (7, a)]
    assert run(docs(rows)) == brute(rows)


def test_keep_one_goes_by_id_and_text(docs):
    """A row is dropped for its own text, not for another row of its id; a copy without
    id goes where a document with one has its text."""
    rng = random.Random(6)
    a, own = prose(rng, 80), prose(rng, 80)
    kept = jj.keep_one(docs([(1, a), (5, a), (5, own), (None, a), (None, "alone without an id here")])).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == sorted([(1, a), (5, own), (-1, "alone without an id here")])


def test_keep_one_and_empty_table(docs):
    rng = random.Random(4)
    a = prose(rng, 100)
    frame = docs([(2, a), (1, a + " more"), (9, "short"), (8, ""), (7, None), (None, a)])
    kept = jj.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [1, 7, 8, 9]
    assert jj.components_of(docs([])).count() == 0 and jj.keep_one(docs([])).count() == 0


def family(seed, n, length=200, changes=3):
    """Edits of one text that is not among them: all pairs are just below the similarity."""
    rng = random.Random(seed)
    base = prose(rng, length).split()
    rows = []
    for i in range(n):
        own = list(base)
        for at in rng.sample(range(length), changes):
            own[at] = f"changed{i}x{at}" if rng.random() < 0.9 else "changed"
        rows.append((i, " ".join(own)))
    return rows


def pairs_made(monkeypatch, docs, rows):
    """Pairs that are held against each other one by one, beside the result."""
    made = []
    verified = jj._verified

    def counting(pairs, sets, percent):
        pairs = jj.store(pairs, "counted")
        made.append(pairs.count())
        return verified(pairs, sets, percent)

    monkeypatch.setattr(jj, "_verified", counting)
    got = run(docs(rows))
    monkeypatch.setattr(jj, "_verified", verified)
    return sum(made), got


def test_families_below_the_similarity(docs, monkeypatch):
    """Pairs grow with the rows, not with their square; the links that there are stay."""
    small, large = family(1, 150), family(1, 300)
    few, got = pairs_made(monkeypatch, docs, small)
    assert got == brute(small)
    many, got = pairs_made(monkeypatch, docs, large)
    assert got == brute(large)
    assert many <= 2.2 * few + 20 and many <= 8 * len(large)


def test_groups_of_several_blocks(docs, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK_CLASSES", 16)
    rows = family(2, 60, length=60, changes=2) + [(100 + i, t) for i, t in family(3, 40, length=80, changes=4)]
    assert run(docs(rows)) == brute(rows)


def test_block_links_join_what_is_similar():
    """Against all pairs: the same joined parts, and no link that joins nothing."""
    import numpy as np
    rng = random.Random(4)
    for _ in range(30):
        base = rng.sample(range(1, 1 << 40), rng.randint(5, 60))
        classes = []
        for i in range(rng.randint(1, 14)):
            own = sorted({*rng.sample(base, max(1, len(base) - rng.randint(0, 9))), *(rng.randrange(1 << 40) for _ in range(rng.randint(0, 5)))})
            classes.append((bytes([i]), bytes([rng.randint(0, i)]), np.array(own, dtype=np.uint64)))

        def joined(links):
            label = {p: p for _, p, _ in classes}

            def find(p):
                while label[p] != p:
                    p = label[p]
                return p
            part = {f: p for f, p, _ in classes}
            for a, b in links:
                x, y = find(part[a]), find(part[b])
                label[max(x, y)] = min(x, y)
            return {p: find(p) for p in label}

        def similar(pairs):
            for (a, _, s), (b, _, t) in pairs:
                shared = len(set(s.tolist()) & set(t.tolist()))
                if 100 * shared >= 80 * (len(s) + len(t) - shared):
                    yield a, b

        half = len(classes) // 2
        whole = [(x, y) for k, x in enumerate(classes) for y in classes[k + 1:]]
        cross = [(x, y) for x in classes[:half] for y in classes[half:]]
        for links, pairs in ((jj.block_links(classes, None, 80), whole), (jj.block_links(classes[:half], classes[half:], 80), cross)):
            assert joined(links) == joined(similar(pairs)) and len(links) < len({p for _, p, _ in classes}) + 1
