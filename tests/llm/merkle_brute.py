import hashlib, zlib
def H(s): return hashlib.sha256(s.encode()).hexdigest()
def f(v): return "-" if v is None else f"{len(str(v).encode())}:{v}"
def leafh(r, text=None): return H("".join(f(x) for x in (r[0], r[3], r[2], r[4], r[1] if text is None else text)))
def tamper(r):
    t = r[1]
    if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and t is not None:
        t = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return t
def tree(nodes):
    """levels list of lists"""
    levels = [nodes]
    while len(levels[-1]) > 1:
        cur = levels[-1]
        levels.append([H("".join(cur[i:i+8])) for i in range(0, len(cur), 8)])
    return levels
def path(levels, i):
    out = []
    for lv in levels[:-1]:
        r = i // 8
        run = lv[r*8:r*8+8]
        out.append((i % 8, [x for k, x in enumerate(run) if k != i % 8]))
        i //= 8
    return out
def fold(h, p):
    for pos, sibs in p:
        h = H("".join(sibs[:pos] + [h] + sibs[pos:]))
    return h
def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)"""
    langs = sorted({r[2] for r in rows}, key=lambda l: (l is not None, (l or "").encode()))
    per = {}
    for l in langs:
        rs = sorted([r for r in rows if r[2] == l], key=lambda r: (r[0] is not None, r[0] or 0, leafh(r)))
        per[l] = (rs, tree([leafh(r) for r in rs]))
    top = tree([per[l][1][-1][0] for l in langs])
    root = top[-1][0]
    out = []
    for li, l in enumerate(langs):
        rs, lv = per[l]
        for i, r in enumerate(rs):
            p = path(lv, i) + path(top, li)
            proof = H("".join("".join(s) for _, s in p))
            fr = fold(leafh(r, tamper(r)), p)
            out.append((r[0], leafh(r), lv[-1][0], root, proof, fr, fr == root))
    return sorted(out, key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
