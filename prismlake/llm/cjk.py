"""Words of Chinese and Japanese that tell whether a clause before a gap is complete and whether a new one opens after it.

Version 1, by hand, from the function words of the two languages; content words aren't listed.
"""

# Particles and endings that close a sentence, longest first where one ends in another.
FINAL = {
    "ja": "でした ました ません である であった ではない なかった された れた です ます だった した ない よ ね か だ た る".split(),
    "zh": "了 吗 呢 吧 啊 而已 为止 在案 云云".split(),
}
# Words that open a sentence.
OPEN = {
    "ja": "しかし また なお さらに そして したがって よって ただし 一方 次に 以上 まず そこで この その これ それ 本件 原告 被告 裁判所 当裁判所 私 彼 彼女 今日 昨日 明日".split(),
    "zh": "但是 但 然而 因此 所以 此外 另外 同时 随后 其后 首先 其次 最后 如果 虽然 本院 法院 原告 被告 双方 这 该 我 我们 他 她 他们 今天 昨天 明天".split(),
}
# Words that go on with a clause, or join what stands on both sides of a gap.
JOIN = {
    "ja": "と や の を に が は も で へ から まで より など および 及び 並びに または 又は".split(),
    "zh": "和 与 及 以及 或 或者 的 、 等 把 被 对 向 从 在 是".split(),
}
WORDS = {lang: {w: kind for kind, table in (("join", JOIN), ("open", OPEN), ("final", FINAL)) for w in table[lang]} for lang in ("ja", "zh")}
LONGEST = max(len(w) for table in WORDS.values() for w in table)


def lattice(chunk: str, lang: str) -> list[tuple[str, str | None]]:
    """The likeliest words of a chunk with their kind: the path of least cost over listed words and single unknown signs."""
    n, words = len(chunk), WORDS[lang]
    cost, back = [0.0] + [1e9] * n, [0] * (n + 1)
    for i in range(n):
        for k in range(1, min(LONGEST, n - i) + 1):
            step = 1.0 if chunk[i : i + k] in words else 1.2 if k == 1 else None
            if step is not None and cost[i] + step < cost[i + k]:
                cost[i + k], back[i + k] = cost[i] + step, i
    out, at = [], n
    while at:
        out.append((chunk[back[at] : at], words.get(chunk[back[at] : at])))
        at = back[at]
    return out[::-1]
