"""The block-wise nearest-neighbour kernel."""

from __future__ import annotations


def block_kernel(k: int, metric: str, chunk: int = 64):
    """``best(query ids, query matrix, ids, matrix)``: k nearest rows per query.

    Returned as a closure, so that tasks need nothing but numpy.
    """

    def best(qids, q, cids, c):
        import numpy as np

        out_q, out_c, out_d = [], [], []
        if metric == "cosine":
            qn = np.linalg.norm(q, axis=1)
            cn = np.linalg.norm(c, axis=1)
        for lo in range(0, len(qids), chunk):
            part = q[lo : lo + chunk]
            if metric == "cosine":
                scale = qn[lo : lo + chunk, None] * cn[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = 1.0 - (part @ c.T) / scale
            else:
                d = (part**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2.0 * (part @ c.T)
            d = np.round(d, 6) + 0.0
            for i in range(len(part)):
                row = d[i]
                ok = np.nonzero(~np.isnan(row))[0]
                if len(ok) > k:
                    limit = np.partition(row[ok], k - 1)[k - 1]
                    ok = ok[row[ok] <= limit]
                order = ok[np.lexsort((cids[ok], row[ok]))][:k]
                out_q.extend([qids[lo + i]] * len(order))
                out_c.extend(cids[order])
                out_d.extend(row[order])
        return out_q, out_c, out_d

    return best
