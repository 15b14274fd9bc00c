"""The expected results, computed row by row on plain Python lists."""

from collections import Counter, defaultdict
from math import ceil

URL = 4  # length of (domain, method, ipport, request)


def best(counter, size, minimum):
    """Terms with enough rows, most frequent first, smaller term first on ties."""
    kept = [(term, n) for term, n in counter.items() if term is not None and n >= minimum]
    return sorted(kept, key=lambda item: (-item[1], item[0]))[:size]


def nested(rows, sizes, minimum):
    """{path: count} of the last level; ``rows`` are tuples of the level values."""
    if len(sizes) == 1:
        return {(t,): n for t, n in best(Counter(r[0] for r in rows), sizes[0], minimum)}
    found = {}
    for term, _ in best(Counter(r[0] for r in rows), sizes[0], minimum):
        inside = [r[1:] for r in rows if r[0] == term]
        for path, n in nested(inside, sizes[1:], minimum).items():
            found[(term, *path)] = n
    return found


def top_urls(rows, options):
    """rows: six-tuples; options: {domain: (min_count, top_urls, top_agents, top_referers)}"""
    found = {}
    for domain, (minimum, urls, _, _) in options.items():
        mine = [r[1:URL] for r in rows if r[0] == domain]
        for path, n in nested(mine, (10, 2, urls), minimum).items():
            found[(domain, *path)] = n
    return found


def top_requests(rows, options):
    """Sorted list of (six keys, count), with '' for a missing referer."""
    by_url = defaultdict(list)
    for r in rows:
        by_url[r[:URL]].append(r[URL:])
    result = []
    for url in top_urls(rows, options):
        minimum, _, agents, referers = options[url[0]]
        second = ceil(minimum / 4)
        for agent, _ in best(Counter(a for a, _ in by_url[url]), agents, second):
            counts = Counter(ref for a, ref in by_url[url] if a == agent)
            if counts[None] > second:
                result.append((*url, agent, "", counts[None]))
            result += [(*url, agent, ref, n) for ref, n in best(counts, referers, second)]
    return sorted(result)
