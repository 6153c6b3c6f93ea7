"""Brute-force version of conversation repair: cheapest path over (rows read, state), whole strings compared."""

import hashlib
import re
import zlib

FORM = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows):
    """[(conv, turn, role, text)] -> {conv: [(turn, role, text)]}."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        kept += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def repair(rows):
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    n = len(rows)
    best = {(0, 0): (0, "", ())}
    for i in range(n + 1):
        for _ in range(8):  # insertions until nothing gets better
            for (j, q), (cost, audit, out) in list(best.items()):
                if j == i:
                    for sym, name in (("u", "user:"), ("a", "assistant:")):
                        if (q, sym) in FORM:
                            better(best, (i, FORM[q, sym]), (cost + 3, audit + "I", out + (name,)))
        if i == n:
            break
        _, role, text = rows[i]
        for (j, q), (cost, audit, out) in list(best.items()):
            if j != i:
                continue
            better(best, (i + 1, q), (cost + 4, audit + "D", out))
            if faults[i] in ("blank", "duplicate"):
                continue
            more = 3 * (faults[i] == "truncated")
            if (q, role[:1]) in FORM:
                better(best, (i + 1, FORM[q, role[:1]]), (cost + more, audit + "K", out + (f"{role}:{text}",)))
            for sym, name in (("u", "user"), ("a", "assistant")):
                if (q, sym) in FORM:
                    better(best, (i + 1, FORM[q, sym]), (cost + 3 + more, audit + "R", out + (f"{name}:{text}",)))
    cost, audit, out = min(best[n, q] for q in (0, 3) if (n, q) in best)
    turns = {t for t, _, _ in rows if t is not None}
    first = [r[1][:1] for r in rows]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def better(best, key, new):
    if key not in best or new[:2] < best[key][:2]:
        best[key] = new
