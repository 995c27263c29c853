"""Plain-Python versions of the clustering, by the definitions, for small inputs."""

from __future__ import annotations

import math
import random

Post = tuple[int, int, float, float]  # user, post, lat, lon


def km(a, b) -> float:
    (la, lo), (lb, lp) = a, b
    h = (
        math.sin(math.radians(lb - la) / 2) ** 2
        + math.sin(math.radians(lp - lo) / 2) ** 2
        * math.cos(math.radians(la))
        * math.cos(math.radians(lb))
    )
    return 2 * 6372.8 * math.asin(min(1.0, math.sqrt(h)))


def plane(a, b) -> float:
    return math.hypot(a[0] - b[0], a[1] - b[1])


def blocks(a, b) -> float:
    return abs(a[0] - b[0]) + abs(a[1] - b[1])


DISTANCES = {"haversine": km, "euclidean": plane, "manhattan": blocks}


def near(posts: list[Post], eps: float, distance) -> dict[int, list[int]]:
    """Neighbours of each post, within its author."""
    found = {}
    for u, i, *a in posts:
        found[i] = [j for v, j, *b in posts if u == v and i != j and distance(a, b) < eps]
    return found


def one_hop(posts: list[Post], eps: float, m: int, distance=km) -> dict[int, int]:
    """Seeds in post order, then each post with its earliest seed."""
    around = near(posts, eps, distance)
    seeds: set[int] = set()
    for i in sorted(around):
        if len(around[i]) >= m and not seeds.intersection(around[i]):
            seeds.add(i)
    labels = {}
    for i in around:
        reach = [s for s in [*around[i], i] if s in seeds]
        if reach:
            labels[i] = min(reach)
    return labels


def dbscan(posts: list[Post], eps: float, m: int, distance=km) -> dict[int, int]:
    around = near(posts, eps, distance)
    core = {i for i in around if len(around[i]) >= m}
    labels = {i: i for i in core}
    changed = True
    while changed:
        changed = False
        for i in core:
            low = min([labels[i], *[labels[j] for j in around[i] if j in core]])
            if low < labels[i]:
                labels[i], changed = low, True
    for i in around:
        reach = [labels[j] for j in around[i] if j in core]
        if i not in core and reach:
            labels[i] = min(reach)
    return labels


def skewed_posts(seed: int, n: int = 260) -> list[Post]:
    """One author holds most posts, many at one spot and many crowded around it; others have few."""
    rng = random.Random(seed)
    posts = []
    for i in rng.sample(range(10 * n), n):
        pick = rng.random()
        if pick < 0.25:
            posts.append((1, i, 40.0, -80.0))
        elif pick < 0.6:
            posts.append((1, i, 40 + rng.gauss(0, 0.0008), -80 + rng.gauss(0, 0.001)))
        elif pick < 0.75:
            posts.append((1, i, 40 + rng.uniform(-0.02, 0.02), -80 + rng.uniform(-0.02, 0.02)))
        else:
            u = rng.randint(2, 9)
            posts.append((u, i, 40 + rng.uniform(-0.002, 0.002), -80 + rng.uniform(-0.002, 0.002)))
    return posts


def edge_posts(seed: int, n: int = 240) -> list[Post]:
    """Posts around both poles and the 180 degree line."""
    rng = random.Random(seed)
    posts = []
    for i in range(n):
        spot = i % 4
        if spot == 0:
            posts.append((1, i, 90 - abs(rng.gauss(0, 0.02)), rng.uniform(-180, 180)))
        elif spot == 1:
            posts.append((1, i, -90 + abs(rng.gauss(0, 0.02)), rng.uniform(-180, 180)))
        elif spot == 2:
            lon = 180 - abs(rng.gauss(0, 0.01)) if rng.random() < 0.5 else -180 + abs(rng.gauss(0, 0.01))
            posts.append((1, i, rng.gauss(0, 0.01), lon))
        else:
            posts.append((1, i, 70 + rng.gauss(0, 0.01), rng.choice([-180, 180]) + rng.gauss(0, 0.0)))
    return posts
