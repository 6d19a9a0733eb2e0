"""Plain-Python versions of rules that several tests compare with."""

import hashlib
from collections import defaultdict

from tests.llm.cases import words


def fair_queue(rows, target, share=1.5):
    """Per row the words taken: two turns of each source's queue, served by finish time.
    ``rows``: (doc_id, text, source); words taken are summed by id."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    place = lambda i, t: int(md5(("" if i is None else str(i)) + ":" + md5(t or ""))[:15], 16)
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((place(i, t), i, len(words(t))))
    rank = {s: n for n, s in enumerate(sorted(by, key=lambda s: (s is None, s)))}
    entries = []
    for s, queue in by.items():
        total, done = sum(q[2] for q in queue), 0
        for p, i, n in sorted(queue, key=lambda q: q[0]):
            done += n
            if n and target[s]:
                entries += [((done + turn * total) / target[s], rank[s], p, turn, i, n) for turn in (0, 1)]
    budget, taken = share * sum(len(words(t)) for _, t, _ in rows), dict.fromkeys((i for i, *_ in rows), 0)
    for *_, i, n in sorted(entries):
        budget -= n
        if budget < 0:
            break
        taken[i] += n
    return taken
