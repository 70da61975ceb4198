"""The selection language: what its names mean is compared with SQL query by query; here are errors, signs and order."""

import pytest

from scanloom.operators import language
from scanloom.plans import language_queries
from scanloom.plans.registry import united

SUB = ["obs_key", "obs_id", "subobs_id", "ctime", "flavor", "slot", "band", "det_type", "nsamp", "dur", "baz", "bel"]
OBS = ["obs_key", "obs_id", "ctime", "flavor", "slots", "nsamp", "dur", "baz", "bel"]


@pytest.mark.parametrize("text", ["nonsense", "ws0,(f090", "'open", "f090)", "bad", "~good", "hits()", "hits(1)", "hits(ws0,2)", "::-1", "f090 # f150", "1:2:0"])
def test_errors(text):
    with pytest.raises(language.SelectionError):
        language.parse(text, SUB)


def test_unknown_names_are_told():
    with pytest.raises(language.SelectionError, match="'moon'"):
        language.parse("f090,moon", SUB)
    assert language.parse("f090,moon", SUB, frozenset({"moon"})).tags == ["moon"]


@pytest.mark.parametrize("text, parts", [("a,b", ["a", "b"]), ("(a,b),'c,d',[e,{f,g}]", ["(a,b)", "'c,d'", "[e,{f,g}]"]), (" , a ,, ", ["a"]), ("", [])])
def test_commas_within_brackets_and_quotes_stay(text, parts):
    assert language.split_top(text) == parts


def test_signs():
    said = lambda text, columns=SUB: language.parse(text, columns).condition
    assert said("+f090") == "(true) and (det_type = 'OPTC')"
    assert said("-f090,optc") == said("~f090,optc") == "((not (band = 'f090'))) and ((det_type = 'OPTC'))"
    assert said("-f090|-ws1|~dark", OBS) == "(true or true or true)"  # observations cannot tell
    assert said("3-nsamp>-dur,optc") == "(3 - nsamp > - dur) and ((det_type = 'OPTC'))"
    assert said("~obs_1:ws0,optc").startswith("((not (obs_id = 'obs_1' and (slot = 'ws0'))))")
    assert language.parse("+bad", SUB).good and language.parse("+bad", SUB).bad


def test_a_quote_in_a_text_cannot_end_it(spark):
    df = spark.createDataFrame([("it's",), ("x\\",)], ["obs_id"])
    assert language.select(df, 'obs_id="it\'s"').count() == 1
    assert language.select(df, "obs_id='x\\'").count() == 1


@pytest.fixture(scope="module")
def rows(spark, small):
    return language_queries._sub(spark, small).where("obs_key < 20").cache()


def ids(df):
    return {r["subobs_id"] for r in df.collect()}


@pytest.mark.parametrize("cond", ["f090", "ws1", "night", "(f090|ws0)&night", "obs_5:ws0", "bel>35", "R", "moon|A", "optc", "ws0&(~f150|R)"])
def test_a_condition_and_its_negation_part_the_rows(spark, small, rows, cond):
    tags = language_queries._tags(spark, small)
    take = lambda text: ids(language.select(rows, text, tags))
    yes, no = take(f"+dark,({cond})"), take(f"+dark,~({cond})")
    assert not yes & no and yes | no == take("+dark")
    assert take(f"+dark,~(~({cond}))") == yes


def test_id_lists_order_and_slices_come_last(spark, rows, tmp_path):
    have = sorted(ids(language.select(rows, "f150,ws0")), reverse=True)
    path = tmp_path / "list.txt"
    path.write_text("# a comment\n" + "\n".join(f"{x}  more words" for x in ["obs_none:ws0:f150", *have, have[0]]) + "\n")
    got = language.select(rows, f"@{path}").orderBy("pos").collect()
    assert [r["subobs_id"] for r in got] == have
    got = language.select(rows, f"@{path},-4:,::2").orderBy("pos").collect()
    assert [r["subobs_id"] for r in got] == have[-4::2]
    path.write_text("obs_8\nobs_2\n")
    got = language.select(rows, f"@{path},ws0").select("obs_id", "pos").distinct().orderBy("pos").collect()
    assert [r["obs_id"] for r in got] == [x for x in ("obs_8", "obs_2") if x in {r["obs_id"] for r in rows.collect()}]


def test_nothing(spark, rows):
    none = rows.limit(0)
    assert language.select(none, "f090,2:5,R", spark.createDataFrame([], "obs_key long, tag string").unionByName(spark.createDataFrame([(1, "R")], "obs_key long, tag string"))).count() == 0


def test_names_are_registered_once():
    with pytest.raises(ValueError, match="twice"):
        united([{"a": 1}, {"a": 2}])
