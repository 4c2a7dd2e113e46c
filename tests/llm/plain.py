"""Plain versions that share nothing with the operators."""

from collections import Counter


def repeated_runs(texts: list[bytes], span: int = 200) -> list[list[tuple[int, int]]]:
    """For each text, the maximal runs [begin, end) of bytes in strings of `span` bytes that start more than once in all texts."""
    seen = Counter(t[p : p + span] for t in texts for p in range(len(t) - span + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for p in range(len(t) - span + 1):
            if seen[t[p : p + span]] > 1:
                covered[p : p + span] = b"\1" * span
        runs, at = [], covered.find(1)
        while at >= 0:
            end = covered.find(0, at)
            end = len(t) if end < 0 else end
            runs.append((at, end))
            at = covered.find(1, end)
        out.append(runs)
    return out
