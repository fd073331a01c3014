from conftest_llm import edge_rows

from tidemill.llm.linededup import drop_repeated_lines


def brute(rows):
    """Rows are (doc_id, text) without nulls, each id once."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if not "".join(w).strip():
                continue
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out[d] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


def test_matches_brute_force(docs_of, words):
    pool = [words.text(4) for _ in range(12)] + [""]
    rows = [(i, "\n".join(words.r.choice(pool) for _ in range(words.r.randint(1, 14)))) for i in range(80)]
    rows.append((100, "\n".join(["same"] * 9)))
    got = {r.doc_id: (r.text, r.lines_removed) for r in drop_repeated_lines(docs_of(rows)).collect()}
    assert got == brute(rows)
    assert got[100] == ("same", 8)


def test_edges(docs_of):
    rows = edge_rows() + [(20, "a\nb\nc"), (20, "a\nb\nc"), (21, "a\nb\nc\n" + "d\n" * 3000), (None, "a\nb\nc"), (22, "\n\n\n\n\n")]
    docs = docs_of(rows, "k m first _id _t _at lines")
    out = drop_repeated_lines(docs)
    assert out.columns == [*docs.columns, "lines_removed"]
    got = sorted((r.doc_id or 0, r.text or "", r.lines_removed) for r in out.collect())
    assert len(got) == len(rows)
    by = {d: (t, n) for d, t, n in got}
    assert by[20] == ("a\nb\nc", 0) and by[22] == ("\n\n\n\n\n", 0)
    assert by[21] == ("d\n", 3 + 2999)
    assert (0, "a\nb\nc", 0) in got
    assert drop_repeated_lines(docs.where("false")).count() == 0


def test_a_column_named_like_the_number_gives_way(docs_of):
    docs = docs_of([(1, "a\nb\nc"), (2, "a\nb\nc")], "lines_removed")
    out = drop_repeated_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "lines_removed"] + ["lines_removed"]
    assert sorted((r.doc_id, r.text, r.lines_removed) for r in out.select("doc_id", "text", "lines_removed").collect()) == [(1, "a\nb\nc", 0), (2, "", 3)]
