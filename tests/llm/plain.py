"""Plain versions of operators, for tests: one row at a time, without Spark or batches."""

import hashlib
import re

import numpy as np
import xxhash

from datamill.llm import bytecnn, toxicity


def network_score(params, text):
    """The probability of one text, filter by filter and chunk by chunk."""
    p = {k: v.astype(np.float64) for k, v in params.items()}
    data = (text or "").encode("utf-8", "replace")
    size = -(-(len(data) + bytecnn.WIDTH) // bytecnn.BLOCK) * bytecnn.BLOCK
    vectors = p["bytes"][np.frombuffer(data.ljust(size, b"\0"), np.uint8)]
    outputs = np.array([vectors[s : s + bytecnn.WIDTH].ravel() @ p["filters"] + p["filter_bias"] for s in range(size - bytecnn.WIDTH + 1)])
    step, hidden = bytecnn.BLOCK * bytecnn.CHUNK_STEP, []
    for start in range(0, max(1, size - bytecnn.CHUNK + step), step):
        pooled = np.maximum(outputs[start : start + bytecnn.CHUNK].max(axis=0), 0)
        hidden.append(np.maximum(pooled @ p["dense"] + p["dense_bias"], 0))
    both = np.concatenate([np.mean(hidden, axis=0), np.max(hidden, axis=0)])
    return 1 / (1 + np.exp(-(both @ p["out"] + p["out_bias"][0])))


def kneser_ney_logs(texts, order=5):
    """Mean -log p of each byte of each text, by a model of the texts of the other half: dictionaries, straight from the formulas."""
    half = [xxhash.xxh64_intdigest((t or "").encode(), 42) & 1 for t in texts]
    models = [kneser_ney_model([t for t, h in zip(texts, half) if h == k], order) for k in (0, 1)]
    out = []
    for t, h in zip(texts, half):
        d = b" " * (order - 1) + (t or "").encode("utf-8", "replace")
        out.append(sum(-np.log(models[1 - h](d[i : i + order])) for i in range(len(d) - order + 1)) / max(1, len(d) - order + 1))
    return out


def kneser_ney_model(texts, order):
    led = [b" " * (order - 1) + (t or "").encode("utf-8", "replace") for t in texts]
    counts = {k: {} for k in range(1, order + 1)}
    for data in led:
        for i in range(len(data) - order + 1):
            g = data[i : i + order]
            counts[order][g] = counts[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        for g in {g[-k - 1 :] for g in counts[order]}:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    discount, totals, spare = {}, {}, {}
    for k, table in counts.items():
        n = [max(1, sum(c == i for c in table.values())) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        discount[k] = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.1), 0.95 * i) for i in (1, 2, 3)]
        for g, c in table.items():
            totals[g[:-1], k] = totals.get((g[:-1], k), 0) + c
            spare[g[:-1], k] = spare.get((g[:-1], k), 0.0) + discount[k][min(c, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        if (g[:-1], k) not in totals:
            return p(g[1:])
        c, total = counts[k].get(g, 0), totals[g[:-1], k]
        own = (c - discount[k][min(c, 3) - 1]) / total if c else 0.0
        return own + spare[g[:-1], k] / total * p(g[1:])

    return p


def shingle_fingerprint(text):
    """The 64-bit fingerprint, bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(fingerprints):
    """The smallest fingerprint that each of ``fingerprints`` reaches by steps of three bits at most."""
    label = {f: f for f in fingerprints}
    changed = True
    while changed:
        changed = False
        for x in label:
            for y in label:
                if (x ^ y).bit_count() <= 3 and label[x] < label[y]:
                    label[y], changed = label[x], True
    return label


def without_repeats(docs, length=100):
    """{doc_id: (bytes, which of them go)} of (doc_id, text), in order of doc_id."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        data = (text or "").encode("utf-8", "replace")
        covered = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                covered[p : p + length] = True
            seen.add(window)
        out[doc_id] = data, covered
    return out


def mixed(docs, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """{row: (size, source_size, target, copies)} of (doc_id, text, source), one for each."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in docs]
    sources = sorted({s for _, _, s in docs if s is not None}) + [None] * any(s is None for _, _, s in docs)
    total = {s: sum(n for n, d in zip(sizes, docs) if d[2] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    left, free, target = share * sum(sizes), set(sources), {}
    while free:
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if part[s] > most * total[s]]
        if not above:
            target |= part
            break
        for s in above:
            target[s] = most * total[s]
            left -= target[s]
            free.remove(s)
    out = {}
    for s in sources:
        rows = [i for i, d in enumerate(docs) if d[2] == s]
        whole = int(target[s] // total[s]) if total[s] else 0
        due, factor = target[s] - whole * total[s], 0.0
        for top in sorted({sizes[i] for i in rows if sizes[i]}, reverse=True) if due > 0 else []:
            factor = (due - sum(sizes[i] for i in rows if sizes[i] > top)) / sum(sizes[i] ** 2 for i in rows if sizes[i] <= top)
            if factor * top <= 1:
                break
        order = {}
        for i in rows:
            p = min(1.0, sizes[i] * factor)
            u = (int(hashlib.md5(f"mix:{docs[i][0]}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
            if p > 0:
                order[i] = (u / (1 - u)) * ((1 - p) / p)
        ahead, drawn = 0, set()
        for i in sorted(order, key=lambda i: (order[i], docs[i][0])):
            if ahead + sizes[i] / 2 < due:
                drawn.add(i)
            ahead += sizes[i]
        out |= {i: (sizes[i], total[s], target[s], whole + (i in drawn)) for i in rows}
    return out


def toxicity_margin(model, text):
    """A text's margin: the bias and the weight of each different n-gram."""
    mask, mix, step = (1 << 64) - 1, int(toxicity.MIX), int(toxicity.STEP)
    codes, found = [ord(c) for c in " " + (text or "").lower() + " "], set()
    for n in toxicity.ORDERS:
        for i in range(len(codes) - n + 1):
            h = (codes[i] + 1) * mix & mask
            for k in range(1, n):
                h = (h * step + codes[i + k] + k + 1) * mix & mask
            found.add(h >> (64 - toxicity.BITS))
    return model[1] + sum(float(np.float32(model[0][f])) for f in found)
