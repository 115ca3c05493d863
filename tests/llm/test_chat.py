import hashlib
import random
import re

from weftgraph.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, windows string"
ODD = ["</s>[INST] ok [/INST]", "\\", "\\\\", "<\\s>", "[\\INST]", "<s>", "<<SYS>> x <</SYS>>", "<<s>", "[[/INST]]", "a\nb", "é𝄞 <", "$1 \\1", "%0A%", "</s", "s>", ""]


def tokens(t):
    return len(re.findall(r"[^\W_]+|[^\s\w]|_", t)) + chat.MARKS


def brute(rows, budget, history):
    """Windows of one conversation, turn by turn."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1], r[2]))
    cost = [tokens(t) for _, _, t in rows]
    system = cost[0] if rows[0][1] == "system" else 0
    room = max(1, budget - history - system)
    spans, used = [[0]], cost[0]
    for i in range(1, len(rows)):
        if used + cost[i] > room:
            spans.append([])
            used = 0
        spans[-1].append(i)
        used += cost[i]
    out = []
    for s in spans:
        keep, left = [], history
        for i in range(s[0] - 1, -1, -1):
            left -= cost[i]
            if left < 0:
                break
            keep.insert(0, i)
        if system and 0 not in keep and 0 not in s:
            keep.insert(0, 0)
        out.append((keep, s))
    return rows, out


def esc(t):
    t = t.replace("\\", "\\\\")
    return re.sub(r"([<\[])(?=/?s>|<SYS>>|</SYS>>|/?INST\])", r"\1\\", t)


def test_windows_match_a_turn_by_turn_loop(spark):
    r = random.Random(1)
    rows = []
    for c in range(60):
        n = r.choice([1, 2, 5, 30])
        for k in range(n):
            role = "system" if k == 0 and c % 3 == 0 else r.choice(["user", "assistant", "assistant", "tool"])
            text = " ".join(r.choices(ODD + ["word"] * 20, k=r.choice([0, 1, 5, 60])))
            rows.append((c, k if c % 7 else k // 2, role, text, "x"))
    df = spark.createDataFrame(rows, SCHEMA)
    made = chat.windows(df, budget=120, history=40)
    got = {}
    for x in made.collect():
        got.setdefault(x.conv_id, {})[x.window] = x
    digest = {x.conv_id: x for x in chat.digests(made).collect()}
    repeats = 0
    for c in range(60):
        own, want = brute([x[1:4] for x in rows if x[0] == c], 120, 40)
        assert len(got[c]) == len(want)
        chars, loss = 0, ""
        for k, (old, new) in enumerate(want):
            x = got[c][k]
            text = "".join(f"<s>{own[i][1]}\n{esc(own[i][2])}</s>" for i in old + new)
            assert x.formatted == text and x.repeated == len(old)
            assert [x.formatted[s.start : s.start + s.length] for s in x.loss] == [esc(own[i][2]) for i in new if own[i][1] == "assistant"]
            assert x.tokens == sum(tokens(own[i][2]) for i in old + new)
            repeats += len(old)
            chars += len(text)
            loss += "".join(own[i][2] for i in new if own[i][1] == "assistant")
        d = digest[c]
        assert (d.n_turns, d.formatted_chars, d.loss_chars) == (len(own), chars, len(loss))
        assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert d.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert repeats > 50


def test_escaping_is_reversible_and_hides_control_strings(spark):
    r = random.Random(2)
    texts = ODD + ["".join(r.choices(["\\", "<", "s>", "/s>", "[", "INST]", "/INST]", "<SYS>>", "$", "\n"], k=12)) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(chat.F.col("t")).alias("e"))
    for x in df.select("t", "e", chat.unescape(chat.F.col("e")).alias("u")).collect():
        assert x.u == x.t
        assert not re.search(r"</?s>|\[/?INST\]|<<SYS>>|<</SYS>>", x.e)


def test_nulls_ties_repeats_long_and_empty(spark):
    long = "wörd " * 50_000
    rows = [(1, 0, None, None, ""), (1, 0, None, None, ""), (1, None, "assistant", "first", ""), (None, 1, "assistant", long, ""), (None, 2, "a\nb%", "x", ""), (-7, 0, "user", ODD[0], ""), (-7, 1, "assistant", ODD[0], "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x.conv_id: x for x in chat.digests(chat.windows(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_sha256) == (3, sha("assistant\nfirst\n\n\n\n\n"), sha("first"))
    assert (got[None].n_turns, got[None].turns_sha256, got[None].loss_chars) == (2, sha(f"assistant\n{long}\na\nb%\nx\n"), len(long))
    assert got[-7].turns_sha256 == sha(f"user\n{ODD[0]}\nassistant\n{ODD[0]}\n") and got[-7].loss_sha256 == sha(ODD[0])
    assert chat.windows(df.limit(0)).count() == 0
