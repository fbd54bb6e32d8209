"""Plain versions that several tests share."""
import numpy as np

N = 50


def plain_repeats(rows):
    """Rows (id, text) -> (id, bytes left)."""
    least = {}
    raws = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for p in range(len(raw) - N + 1):
            w = raw[p:p + N]
            least[w] = min(least.get(w, float("inf")), i)
    out = []
    for (own, _), (i, raw) in zip(rows, raws):
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - N + 1):
            if least[raw[p:p + N]] < i:
                gone[p:p + N] = True
        out.append((own, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
    return out
