"""Small numpy statements of the operators, used as brute-force references."""

import numpy as np


def mask_frame(spark, masks):
    """Pixels of named boolean arrays."""
    rows = [(k, m.shape[0], m.shape[1], int(y), int(x)) for k, m in masks.items() for y, x in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "image_id string, fh int, fw int, y int, x int")


def to_array(runs, shape, image="a"):
    out = np.zeros(shape, bool)
    for r in runs.filter(runs.image_id == image).collect():
        assert not out[r.y, r.x0:r.x1 + 1].any(), "runs overlap"
        out[r.y, r.x0:r.x1 + 1] = True
    return out


def dilate(m, offs):
    out = np.zeros_like(m)
    for y, x in zip(*np.nonzero(m)):
        for dy, dx in offs:
            if 0 <= y + dy < m.shape[0] and 0 <= x + dx < m.shape[1]:
                out[y + dy, x + dx] = True
    return out


def erode(m, offs, outside):
    out = np.zeros_like(m)
    for y in range(m.shape[0]):
        for x in range(m.shape[1]):
            out[y, x] = all(m[y + dy, x + dx] if 0 <= y + dy < m.shape[0] and 0 <= x + dx < m.shape[1] else outside for dy, dx in offs)
    return out


def components(m, conn):
    lab, n = np.zeros(m.shape, int), 0
    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (conn == 8 or dy * dx == 0)]
    for y, x in zip(*np.nonzero(m)):
        if lab[y, x]:
            continue
        n, todo = n + 1, [(y, x)]
        lab[y, x] = n
        while todo:
            a, b = todo.pop()
            for dy, dx in near:
                q = (a + dy, b + dx)
                if 0 <= q[0] < m.shape[0] and 0 <= q[1] < m.shape[1] and m[q] and not lab[q]:
                    lab[q] = n
                    todo.append(q)
    return lab
