def documents_of(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def near_pairs(texts, similarity=0.8):
    """Links, components and copies by brute force over all pairs of different texts."""
    ids = {}
    for i, t in texts:
        ids.setdefault(tuple((t or "").encode().split()), []).append(i)
    sets = {w: {w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set() for w in ids}
    links, root = dict.fromkeys(ids, 0), {w: w for w in ids}

    def find(w):
        while root[w] != w:
            w = root[w]
        return w

    words = list(ids)
    for x in range(len(words)):
        for y in range(x):
            a, b = words[x], words[y]
            common = len(sets[a] & sets[b])
            if common and common >= similarity * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for w in words:
        least[find(w)] = min(least.get(find(w), 1 << 60), min(ids[w]))
    return {i: (least[find(w)], min(m), links[w]) for w, m in ids.items() for i in m}
