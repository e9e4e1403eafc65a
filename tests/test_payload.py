import random

import numpy as np
import pytest

from lodestone.operators import payload


def canonical(points, faces):
    p = [tuple(v) for v in np.asarray(points).tolist()]
    out = []
    for f in faces.tolist():
        t = [p[v] for v in f]
        k = t.index(min(t))
        out.append(tuple(t[k:] + t[:k]))
    return sorted(out)


def grid(n, m):
    p = np.array([(3 * x, 5 * y, (x * x + y) % 7) for y in range(m) for x in range(n)])
    f = [t for y in range(m - 1) for x in range(n - 1) for a in [y * n + x] for t in ((a, a + 1, a + n), (a + 1, a + n + 1, a + n))]
    return p, np.array(f)


@pytest.mark.parametrize("seed", range(6))
def test_meshes(seed):
    rng = random.Random(seed)
    p, f = grid(rng.randint(2, 14), rng.randint(2, 14))
    f = np.array([t for t in f.tolist() if seed < 2 or rng.random() < 0.7] + [[0, 1, 2]] * (seed == 5)).reshape(-1, 3)
    q, g = payload.decode_mesh(payload.encode_mesh(p, f))
    assert canonical(q, g) == canonical(p, f)


def test_closed_and_non_manifold():
    p = np.array([(x, y, z) for x in (0, 9) for y in (0, 9) for z in (0, 9)])
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    f = np.array([t for a, b, c, d in quads for t in ((a, b, c), (a, c, d))])
    for faces in (f, np.concatenate([f, [[0, 1, 7], [0, 1, 6]]]), f[:0]):
        q, g = payload.decode_mesh(payload.encode_mesh(p, faces))
        assert canonical(q, g) == canonical(p, faces)


def test_clouds():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 500):
        p = rng.integers(0, 1 << 12, (n, 3))
        q = payload.decode_cloud(payload.encode_cloud(np.concatenate([p, p[:1]])))
        assert sorted(map(tuple, q.tolist())) == sorted({tuple(v) for v in p.tolist()})
    zero = np.zeros((1, 3), np.int64)
    assert payload.decode_cloud(payload.encode_cloud(zero)).tolist() == [[0, 0, 0]]
