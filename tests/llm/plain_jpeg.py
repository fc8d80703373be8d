"""A JPEG scan read bit by bit, for comparison."""

from lexigrid.llm.media import _restarts


def _lookup(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    table, code, k = {}, 0, 0
    for size, n in enumerate(lengths, 1):
        for _ in range(n):
            table[size, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = [int(x) for byte in data.replace(b"\xff\0", b"\xff") for x in f"{byte:08b}"], 0

    def take(self, n: int) -> int:
        out = 0
        for bit in self.data[self.at : self.at + n]:
            out = out * 2 + bit
        self.at += n
        return out

    def symbol(self, table: dict) -> int:
        code = 0
        for size in range(1, 17):
            code = code * 2 + self.data[self.at]
            self.at += 1
            if (size, code) in table:
                return table[size, code]
        raise ValueError("no such code")


def walk(image: dict, first: int, one: bool, cols: int, rows: int, tall: int, wide: int) -> list:
    tables = {k: _lookup(*v) for k, v in image["huff"].items()}
    y, level = image["parts"][first], [[0] * cols for _ in range(rows)]
    across = cols if one else -(-image["width"] // (8 * wide))
    units = across * (rows if one else -(-image["height"] // (8 * tall)))
    unit = 0
    for run in _restarts(image["scan"]):
        bits, last = _Bits(run), dict.fromkeys(image["parts"], 0)
        for _ in range(min(image["restart"] or units, units - unit)):
            for part, dc, ac in image["order"]:
                h, v = (1, 1) if one else (image["parts"][part]["h"], image["parts"][part]["v"])
                for k in range(h * v):
                    size = bits.symbol(tables[dc])
                    value = bits.take(size)
                    last[part] += value if not size or value >> (size - 1) else value - (1 << size) + 1
                    n = 1
                    while n < 64:
                        symbol = bits.symbol(tables[16 + ac])
                        if symbol == 0:
                            break
                        n += (symbol >> 4) + 1
                        bits.take(symbol & 15)
                    r, c = unit // across * (1 if one else y["v"]) + k // h, unit % across * (1 if one else y["h"]) + k % h
                    if part == first and r < rows and c < cols:
                        level[r][c] = last[part]
            unit += 1
    return level
