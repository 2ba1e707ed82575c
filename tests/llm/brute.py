"""Plain single-process versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter

import public_tokenizers
import tiktoken
import xxhash

from floodlake.llm import bpe

RANKS = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def lower(text):
    return (text or "").encode().lower().decode()


def bpe_row(text):
    ids = TIK.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def license_row(text, base):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    found = []
    for label, phrase in base:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    at = [i for i, _ in found]
    return (len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})))


def license_labels(text, lib):
    """The labels of a text: votes of one template after another, no joins."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    labels = set(license_row(text, lib.BASE_PHRASES)[4].split(",")) - {""}
    spans = []
    for tid, (label, phrase) in enumerate(lib.TEMPLATES):
        p = phrase.split()
        grams = list(zip(p, p[1:]))
        musts = {k for k, g in enumerate(grams) if re.search(r"\d", "".join(g))}
        diagonals = {}
        for pos, gram in enumerate(zip(words, words[1:])):
            for k, g in enumerate(grams):
                if g == gram:
                    diagonals.setdefault(pos - k, []).append((pos, k))
        run = []
        for first, diag, hits in sorted((h[0][0], d, h) for d, h in diagonals.items()):
            if run and abs(diag - run[-1][0]) <= lib.NEAR and first - run[-1][1][-1][0] <= lib.GAP:
                run.append((diag, hits))
                spans[-1][1].extend(hits)
            else:
                run = [(diag, hits)]
                spans.append((tid, list(hits), label, len(grams), musts))
    found = []
    for tid, hits, label, total, musts in spans:
        first, last = min(p for p, _ in hits), max(p for p, _ in hits)
        cover = min(len(hits) / total, 1.0)
        if cover >= lib.COVER and sum(k in musts for _, k in hits) >= len(musts) and last - first + 2 <= total + 1 + lib.GAP:
            found.append((first, last, tid, label, cover, len(hits)))
    stretches, reach = [], -1
    for span in sorted(found):
        if not stretches or span[0] > reach:
            stretches.append([])
        stretches[-1].append(span)
        reach = max(reach, span[1])
    for stretch in stretches:
        best = max(stretch, key=lambda x: (x[4], x[5], -x[0], x[1], x[3]))
        labels |= {x[3] for x in stretch if x[3] == best[3] or x[1] < best[0] or x[0] > best[1] or x[4:] >= best[4:]}
    return ",".join(sorted(labels))


def quality_row(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {p for i, w in enumerate(windows) if count[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps):
    """doc_id -> smallest doc_id reachable over links of at most two bits;
    ``fps``: doc_id -> fingerprint."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    by = {}
    for fp in fps.values():
        root(fp)
    distinct = sorted(set(fps.values()))
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                up[root(a)] = root(b)
    for d, fp in fps.items():
        r = root(fp)
        by[r] = min(by.get(r, d), d)
    return {d: by[root(fp)] for d, fp in fps.items()}


def dedup_rows(docs):
    """(doc_id, keep_id, group_size, kept, sha) of (doc_id, text) rows; of
    equal rows one is kept."""
    groups = {}
    for d, text in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), d is None, d if d is not None else 0, d))
    out = []
    for body, rows in groups.items():
        rows.sort(key=lambda r: r[:3])
        out += [(d, rows[0][3], len(rows), k == 0, hashlib.sha256(body.encode()).hexdigest()) for k, (*_, d) in enumerate(rows)]
    return out


def sort_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def line_rows(docs):
    """(doc_id, n_lines, n_dropped, kept text) of (doc_id, text) rows."""
    def key(line):
        k = line.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
        return k if len(k) >= 10 else None
    first = {}
    for d, text in docs:
        for line in (text or "").split("\n"):
            if key(line) is not None:
                order = (d is None, d or 0)
                first[key(line)] = min(first.get(key(line), order), order)
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) is None or first[key(x)] == (d is None, d or 0)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def spelling_counts(docs, min_chars=7, min_count=2):
    """word -> n of (doc_id, text) rows, every 31st word of a document with a letter less."""
    counts = Counter()
    for d, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{'null' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if n >= min_count and len(w) >= min_chars}


def spelling_rows(counts, ratio=10):
    """(word, form, root, n, n_near, form_n) rows of word -> n."""
    letters = sorted({c for w in counts for c in w})
    form, near = {}, {}
    for w in counts:
        around = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        around |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        around = (around & counts.keys()) - {w}
        near[w] = len(around)
        best = min(around, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], near[w], counts.get(form[w])))
    return out


def alignment_rows(docs):
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of
    (doc_id, text) rows, each text tokenized whole."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    a_bytes = {i: bytes(chars[c] for c in t) for t, i in a_tok.get_vocab(with_added_tokens=False).items()}

    def b_bytes(i):
        p = b_tok.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
    found, held = [], Counter()
    for d, text in docs:
        data = (" " + (text or "")).encode()
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        if not text or b"".join(a_bytes[x] for x in a) != data or b"".join(map(b_bytes, b)) != data:
            found.append((d, 0, 0, 0, [], ""))
            continue
        spans = []
        for ids, of in ((a, a_bytes.__getitem__), (b, b_bytes)):
            at, mine = 0, []
            for x in ids:
                mine.append((at, at + len(of(x)), x))
                at += len(of(x))
            spans.append(mine)
        links, j = [], 0
        for lo, hi, x in spans[0]:
            while spans[1][j][1] <= lo:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < hi:
                links.append((x, spans[1][k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, pos = [], [0, 0]
        for cut in cuts:
            sides = []
            for s in (0, 1):
                begin = pos[s]
                while pos[s] < len(spans[s]) and spans[s][pos[s]][1] <= cut:
                    pos[s] += 1
                sides.append(",".join(str(x) for _, _, x in spans[s][begin:pos[s]]))
            groups.append("|".join(sides))
        found.append((d, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        held.update(set(links))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    return [(d, a, b, g, len(links), sha, sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links))
            for d, a, b, g, links, sha in found]
