"""Direct versions that several tests compare with."""

import random


def shingles(text, n=5):
    w = (text or "").lower().translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_links(rows, t=0.8):
    sets = [shingles(x) for _, x in rows]
    links = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                if len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9:
                    links[i].add(j)
    group = list(range(len(rows)))
    for _ in rows:
        for i, own in enumerate(links):
            for j in own:
                group[i] = min(group[i], group[j])
    return links, group


def near_copies():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    rows, key = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((key, " ".join(copy)))
            key += 1
    base = [rng.choice(vocab) for _ in range(120)]
    for i in range(300):  # one crowd of near copies, too large for a node
        copy = list(base)
        copy[i % 120] = f"z{i}"
        rows.append((key, " ".join(copy)))
        key += 1
    odd = [(900, None), (901, ""), (902, " \n"), (903, "Two WORDS"), (904, "two\twords"), (905, "two words"), (None, "two words"), (906, "long " * 20_000), (907, "é ß " * 9)]
    return rows + odd
