"""Token alignment said plainly: whole texts, nested loops, dictionaries."""

import hashlib
from collections import Counter

import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

A = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def _alphabet():
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, n = {chr(x): x for x in plain}, 0
    for x in range(256):
        if x not in plain:
            out[chr(256 + n)] = x
            n += 1
    return out


BYTE = _alphabet()


def _b_bytes(piece):
    return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()


def tokens(text):
    """Two lists of (id, begin, end), or two empty ones."""
    if not text:
        return [], []
    want, out = (" " + text).encode(), []
    ea = A.encode(" " + text, add_special_tokens=False)
    for pairs in ([(i, bytes(BYTE[c] for c in t)) for i, t in zip(ea.ids, ea.tokens)], [(i, _b_bytes(B.id_to_piece(i))) for i in B.encode(text)]):
        if b"".join(x for _, x in pairs) != want:
            return [], []
        at, row = 0, []
        for i, x in pairs:
            row.append((i, at, at + len(x)))
            at += len(x)
        out.append(row)
    return tuple(out)


def align(docs):
    """(doc_id, text) pairs -> sorted result rows as tuples."""
    count, links, found = Counter(), [], [tokens(t) for _, t in docs]
    for a, b in found:
        mine, j = [], 0
        for i, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            while j < len(b) and b[j][1] < e:
                if b[j][2] > s:
                    mine.append((i, b[j][0]))
                j += 1
        links.append(mine)
        count.update(mine)
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    rows = []
    for (doc, _), (a, b), mine in zip(docs, found, links):
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, s = [], 0
        for e in ends:
            groups.append(",".join(str(i) for i, x, y in a if s <= x and y <= e) + "|" + ",".join(str(i) for i, x, y in b if s <= x and y <= e))
            s = e
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        rows.append((doc, len(a), len(b), len(groups), len(mine), sum(count[x] == most[x[1]] for x in mine), sum(count[x] for x in mine), sha))
    return sorted(rows)
