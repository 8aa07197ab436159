"""License scan: phrases against brute force, notices with words added, left out or changed, edge cases."""

import random
import re

from tabprobe.llm.license_scan import NOTICES, PHRASES, Template, scan_licenses, template_words

SCHEMA = "doc_id bigint, text string, tpl int, words string, place int"


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, None, 2) for r in rows], SCHEMA)


def brute_phrases(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, t.label) for t in PHRASES for ws in [template_words(t.text)] for i in range(len(words)) if words[i:i + len(ws)] == ws]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_phrases_against_brute_force(spark):
    rng = random.Random(4)
    parts = ["CC BY", "cc-by", "General Public License", "general", "public", "All Rights Reserved", "all rights", "reserved", "K", "É", "cc",
             "by", "\n", "... ", "1.0", "\x7f", "ALL", "漢字", "rights\treserved"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(14)))) for i in range(250)]
    rows += [(900, None), (901, ""), (902, "cc"), (None, "cc by"), (None, "cc by"), (None, None), (903, "cc by " * 30_000), (904, "x" * 100_000),
             (905, "all rights reserved all rights reserved"), (5, "all rights reserved"), (5, "all rights reserved")]
    got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in
           scan_licenses(made(spark, rows).repartition(3)).collect()]
    want = [(i, *brute_phrases(t)) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def labels_of(spark, texts, **kw):
    rows = scan_licenses(made(spark, list(enumerate(texts))), **kw).orderBy("doc_id").collect()
    return [(r["labels"], round(r["score"], 3), [tuple(s)[:3] for s in r["spans"]]) for r in rows]


def test_notices(spark):
    mit = template_words(NOTICES[12].text)
    assert NOTICES[12].label == "mit" and len(mit) > 15
    more = ["start", *mit[:8], "really", *mit[8:], "end"]
    less = [*mit[:6], *mit[7:]]
    half = mit[:len(mit) // 2]
    got = labels_of(spark, [" ".join(mit), " ".join(more), " ".join(less), " ".join(half), "nothing here", "",
                            "This work is licensed under the GNU General Public License, version 3.",
                            "This work is licensed under the GNU General Public License, version 4.",
                            "Licensed under CC BY-NC 4.0.", " ".join(mit) + " and " + " ".join(mit), " ".join(reversed(mit))])
    assert got[0] == ("mit", 1.0, [(0, len(mit) - 1, "mit")])
    assert got[1][0] == "mit" and got[1][2] == [(1, len(more) - 2, "mit")] and 0.8 < got[1][1] < 1
    assert got[2][0] == "mit" and got[2][1] < 1
    assert got[3][0] == "" and 0 < got[3][1] < 0.8
    assert got[4] == got[5] == ("", 0.0, [])
    assert got[6][0] == "gpl,gpl-3.0" and got[7][0] == "gpl" and got[8][0] == "cc-by,cc-by-nc-4.0"
    assert [s[:2] for s in got[9][2]] == [(0, len(mit) - 1), (len(mit) + 1, 2 * len(mit))]
    assert got[10][:2] == ("", 0.0)


def test_own_templates_and_empty_table(spark):
    own = [Template("libre", "Tous droits réservés", True)]
    assert labels_of(spark, ["TOUS DROITS RéSERVéS.", "tous droits RÉSERVÉS"], phrases=own, notices=[]) == [("libre", 1.0, [(0, 2, "libre")]), ("", 0.0, [])]
    assert scan_licenses(made(spark, [])).count() == 0
