from __future__ import annotations

from decimal import Decimal

from fixtures import frames

from titlelake.plans import documents


def test_title_document(edges):
    docs = {r["id"]: r.asDict(recursive=True) for r in documents.title_documents(edges, placeholder="none").collect()}
    assert len(docs) == 9
    one = docs["tt1"]
    assert one["genres"] == ["Crime", "Drama"]
    assert one["directors"] == [{"id": "nm3", "name": "Ben", "category": "director"}]
    assert one["writers"] == [{"id": "nm3", "name": "Ben", "category": "writer"}]
    assert [(c["id"], c["character"]) for c in one["cast"]] == [
        ("nm1", '["Lead","Twin"]'), ("nm1", "[]"), ("nm2", "not json"),
    ]
    assert (one["rating"], one["votes"], one["poster"]) == (Decimal("8.0"), 30000, "/one.jpg")
    assert (docs["tt2"]["poster"], docs["tt2"]["genres"], docs["tt2"]["writers"]) == ("none", [], [])


def test_cast_is_capped_and_crew_is_not(spark):
    credits = [("tt1", n, "nm1", "actor" if n % 2 else "director", None, str(n)) for n in range(1, 61)]
    cat = frames(
        spark,
        title=[("tt1", "movie", "A", "A", False, None, None, None, None)],
        person=[("nm1", "Ana", None, None)],
        principal=credits,
    )
    doc = documents.title_documents(cat).collect()[0]
    assert [c["character"] for c in doc["cast"]] == [str(n) for n in range(1, 30, 2)]
    assert len(doc["directors"]) == 30


def test_credits_keep_billing_order_within_first_seen_categories(edges):
    docs = {r["id"]: r for r in documents.credits_by_category(edges).collect()}
    found = [(g["category"], [c["ordering"] for c in g["credits"]]) for g in docs["tt1"]["credits"]]
    assert found == [
        ("actor", [1, 3]), ("actress", [2]), ("writer", [4]), ("director", [5]), ("stunts", [6]), ("editor", [7]),
    ]
    assert docs["tt5"]["credits"] == []


def test_person_document(edges):
    docs = {r["id"]: r for r in documents.person_documents(edges).collect()}
    assert len(docs) == 4
    groups = {g["category"]: [t["id"] for t in g["titles"]] for g in docs["nm1"]["filmography"]}
    assert groups == {"actor": ["tt1", "tt4", "tt2"], "actress": ["tt1"]}
    assert [g["category"] for g in docs["nm3"]["filmography"]] == [
        "writer", "director", "stunts", "editor", "producer",
    ]
    assert docs["nm4"]["filmography"] == []


def test_person_document_caps_each_category(spark):
    titles = [(f"tt{n}", "movie", str(n), str(n), False, 1900 + n, None, None, None) for n in range(80)]
    cat = frames(
        spark,
        title=titles,
        person=[("nm1", "Ana", None, None)],
        principal=[(f"tt{n}", 1, "nm1", "actor", None, None) for n in range(80)],
    )
    group = documents.person_documents(cat).collect()[0]["filmography"][0]
    assert [t["year"] for t in group["titles"]] == list(range(1979, 1929, -1))


def test_series_documents(edges):
    found = {(r["id"], r["season"]): r for r in documents.series_documents(edges, "tt4").collect()}
    assert set(found) == {("tt4", 0), ("tt4", 1), ("tt4", None)}
    assert {tuple(r["seasons"]) for r in found.values()} == {(0, 1)}
    assert [(e["episode_number"], e["id"], e["votes"]) for e in found["tt4", 0]["episodes"]] == [(2, "tt5", 90000), (None, "tt8", None)]
    other = documents.series_documents(edges, "tt1").collect()
    assert [(r["season"], r["seasons"], r["episodes"]) for r in other] == [(None, [], [])]
