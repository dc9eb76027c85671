"""Deep-shallow sorting of equally long byte rows, for the tasks of the suffix-array operator."""

from __future__ import annotations

import numpy as np

WORD = 8


def blind_trie_order(keys: list[int], width: int) -> list[int]:
    """Sorted order of big-endian numbers of `width` bytes by insertion into a blind trie.

    An inner node is [depth, {byte: child}] and holds no more of its strings than the branching
    bytes; a leaf is (list of equal members). A search goes down blindly to some leaf; one
    comparison with that leaf gives the depth at which the new string branches off.
    """
    bits = 8 * width
    byte = lambda x, d: x >> (bits - 8 * d - 8) & 255
    root = (0,)
    leaves = {0: [0]}
    for i in range(1, len(keys)):
        x, node = keys[i], root
        while isinstance(node, list):
            node = node[1].get(byte(x, node[0])) or next(iter(node[1].values()))
        other = keys[node[0]]
        if other == x:
            leaves[node[0]].append(i)
            continue
        depth = (bits - (other ^ x).bit_length()) // 8
        up, at = None, root
        while isinstance(at, list) and at[0] < depth:
            up, at = at, at[1][byte(x, at[0])]
        leaves[i] = [i]
        if isinstance(at, list) and at[0] == depth:
            at[1][byte(x, depth)] = (i,)
            continue
        new = [depth, {byte(other, depth): at, byte(x, depth): (i,)}]
        if up is None:
            root = new
        else:
            up[1][byte(x, up[0])] = new
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo.extend(node[1][b] for b in sorted(node[1], reverse=True))
        else:
            out.extend(leaves[node[0]])
    return out


def deep_shallow(rows: np.ndarray, lengths: np.ndarray, segment: np.ndarray, shallow: int) -> np.ndarray:
    """Order that sorts rows within each segment (ascending), a shorter row first among equals.

    rows: bytes padded with zeros, a multiple of 8 wide. The multikey quicksort partitions every
    open segment around a pivot word into less, equal and greater at once; the equal part goes on
    eight bytes deeper. Segments that are still together at depth `shallow` go to blind tries.
    """
    n, width = rows.shape
    if not n:
        return np.zeros(0, np.int64)
    words = rows.view(">u8").reshape(n, width // WORD)
    order = np.argsort(segment, kind="stable")
    seg = segment[order]
    first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    size = np.diff(np.r_[first, n])
    depth = np.zeros(len(first), np.int64)
    deep: list[tuple[int, int]] = []
    while len(first):
        full = depth * WORD >= shallow
        deep.extend(zip(first[full & (size > 1)], size[full & (size > 1)]))
        keep = (size > 1) & ~full
        first, size, depth = first[keep], size[keep], depth[keep]
        if not len(first):
            break
        owner = np.repeat(np.arange(len(first)), size)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        place = first[owner] + offset
        item = order[place]
        word = words[item, depth[owner]]
        pivot = words[order[first + size // 2], depth]
        side = np.where(word < pivot[owner], 0, np.where(word == pivot[owner], 1, 2))
        part = owner * 3 + side
        order[place] = item[np.argsort(part, kind="stable")]
        count = np.bincount(part, minlength=3 * len(first))
        start = np.repeat(first, 3) + (np.cumsum(count.reshape(-1, 3), axis=1) - count.reshape(-1, 3)).ravel()
        first, size, depth = start, count, np.repeat(depth, 3) + np.tile([0, 1, 0], len(first))
    at = shallow // WORD * WORD
    for s, m in deep:
        item = order[s : s + m]
        tail = rows[item, at:]
        if m == 2:
            a, b = tail[0].tobytes(), tail[1].tobytes()
            if a > b or a == b and lengths[item[0]] > lengths[item[1]]:
                order[s : s + 2] = item[::-1]
            continue
        item = item[np.argsort(lengths[item], kind="stable")]
        tail = rows[item, at:]
        order[s : s + m] = item[blind_trie_order([int.from_bytes(x.tobytes(), "big") for x in tail], width - at)]
    return order


def neighbour_lcp(rows: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each row in `order` with the one before it (0 for the first), never beyond a row's own length."""
    a, b = rows[order[1:]], rows[order[:-1]]
    differ = a != b
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.r_[0, np.minimum(lcp, np.minimum(lengths[order[1:]], lengths[order[:-1]]))] if len(order) else np.zeros(0, np.int64)
