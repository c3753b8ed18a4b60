from datetime import datetime, timedelta, timezone

import pytest
from conftest import START, legacy, timeline
from pyspark.sql import functions as F
from test_entropy import brute_cce

from accountlens.operators.evaluation import label_union
from accountlens.operators.posts import post_view
from accountlens.operators.profiles import latest_profile, profile_features
from accountlens.plans.features import (
    ACCOUNT_COLUMNS,
    account_features,
    features_from_measures,
    overlapping_accounts,
    post_features,
    post_measures,
)
from accountlens.schema import FEATURE_COLUMNS, PREDICTION_COLUMNS

NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def expected_row(posts):
    """The features of one account's posts, spelled out."""
    posts = [p for p in posts if p.get("text")]
    when = lambda p: datetime.strptime(p["created_at"], "%a %b %d %H:%M:%S %z %Y")
    n = len(posts)
    times = sorted(int(when(p).timestamp()) for p in posts)
    gaps = [b - a for a, b in zip(times, times[1:])]
    user = max(posts, key=lambda p: (when(p), p["id"]))["user"]
    row = {f"hora_{h}": sum(when(p).hour == h for p in posts) / n for h in range(24)}
    row |= {d: sum(when(p).weekday() == i for p in posts) / n for i, d in enumerate(NAMES)}
    web = ["Twitter Web Client" in p["source"] for p in posts]
    mobile = [not w and "Android" in p["source"] for w, p in zip(web, posts)]
    size = lambda p, k: len((p.get("entities") or {}).get(k) or [])
    words = [p["text"].split(" ") for p in posts]
    followers, friends = user["followers_count"] or 0, user["friends_count"] or 0
    return row | {
        "nroTweets": n,
        "uso_web": sum(web) / n,
        "uso_mobil": sum(mobile) / n,
        "uso_terceros": 1 - (sum(web) + sum(mobile)) / n,
        "avg_diversidad_lex": sum(len(set(p["text"])) / len(p["text"]) for p in posts) / n,
        "avg_long_tweets": sum(len(p["text"]) for p in posts) / n,
        "avg_palabras": sum(map(len, words)) / n,
        "avg_diversidad_palabras": sum(len(set(w)) / len(w) for w in words) / n,
        "url_ratio": sum(size(p, "urls") for p in posts) / n,
        "avg_hashtags": sum(size(p, "hashtags") for p in posts) / n,
        "mention_ratio": sum(size(p, "user_mentions") for p in posts) / n,
        "reply_ratio": sum(bool(p.get("in_reply_to_status_id")) for p in posts) / n,
        "avg_spam": 0.0,
        "entropia": brute_cce(gaps[1:110]),
        "ano_registro": int(user["created_at"][-4:]),
        "con_descripcion": int(bool(user["description"])),
        "con_geo_activo": int(bool(user["geo_enabled"])),
        "con_imagen_default": int(bool(user["default_profile_image"])),
        "con_imagen_fondo": int(bool(user["profile_use_background_image"])),
        "con_perfil_verificado": int(bool(user["verified"])),
        "followers_ratio": followers / friends if friends > 0 else 0.0,
        "reputacion": followers / (followers + friends) if followers + friends > 0 else 0.0,
        "n_favoritos": user["favourites_count"] or 0,
        "n_listas": user["listed_count"],
        "n_tweets": user["statuses_count"],
        "nombre_usuario": user["screen_name"],
    }


def population():
    texts = ["Hello  world", "line\nbreak", "😀 x 😀", "a a a"]
    sources = ["<a>Twitter Web Client</a>", "Twitter for Android", "other"]
    irregular = [(i * 7919) % 50_000 for i in range(40)]
    posts = timeline(1, irregular, texts, sources)
    posts += timeline(2, [3600] * 30, "same", followers_count=0, friends_count=0)
    posts += timeline(3, [60, 9000] * 30, texts, friends_count=0, description="")
    posts += timeline(4, [5, 6, 7])  # three gaps: dropped
    posts += timeline(5, [5, 6, 7, 900])  # four: kept
    posts += timeline(6, [i * i for i in range(200)], texts, verified=True)
    posts += timeline(7, [0, 0, 500, 0, 20], description=None, favourites_count=None)
    for i, p in enumerate(posts):
        if i % 5 == 0:
            p["in_reply_to_status_id"] = i  # the first one is 0: not a reply
            p["entities"]["urls"] = [{"url": "u", "expanded_url": "e"}] * (i % 3)
        if i % 7 == 0:
            p["entities"]["hashtags"] = None
        if i % 11 == 0:
            p["entities"] = None
    posts.append({**posts[0], "id": 1, "text": ""})
    posts.append({**posts[0], "id": 2, "text": None})
    changed = timeline(1, [], first=START + timedelta(days=60), followers_count=77, screen_name="renamed")
    return posts + changed


def by_account(rows, key=lambda p: p["user"]["id"]):
    groups = {}
    for p in rows:
        groups.setdefault(key(p), []).append(p)
    return groups


def check(row, expected):
    for name, value in expected.items():
        if isinstance(value, str):
            assert row[name] == value, name
        else:
            assert row[name] == pytest.approx(value, abs=1e-9), name


def test_account_features(posts_of):
    rows = population()
    out = account_features(posts_of(rows))
    assert out.columns == ACCOUNT_COLUMNS
    got = {r.user_id: r.asDict() for r in out.collect()}
    groups = by_account(rows)
    assert set(got) == {1, 2, 3, 5, 6, 7}
    assert got[1]["nombre_usuario"] == "renamed" and got[1]["categoria"] == -1.0
    for account, row in got.items():
        check(row, expected_row(groups[account]))


def test_features_hold_no_nulls(posts_of):
    df = account_features(posts_of(population())).select(*FEATURE_COLUMNS)
    assert df.dropna().count() == df.count()


def test_staged_measures_give_the_same_features(spark, posts_of, tmp_path):
    posts = posts_of(population())
    measures = post_measures(posts)
    assert "text" not in measures.columns
    measures.write.parquet(str(tmp_path / "stage"))
    staged = features_from_measures(spark.read.parquet(str(tmp_path / "stage"))).drop("createdAt")
    direct = account_features(posts).drop("createdAt")
    key = lambda r: r.user_id
    for a, b in zip(sorted(staged.collect(), key=key), sorted(direct.collect(), key=key), strict=True):
        for name in a.asDict():
            assert a[name] == (pytest.approx(b[name]) if isinstance(b[name], float) else b[name])


def test_account_in_two_classes(posts_of):
    human = timeline(1, [50, 60, 70, 80, 1000], "human text") + timeline(2, [9] * 6)
    bot = timeline(1, [1, 2, 3, 400, 5], "bot", first=START + timedelta(days=3), screen_name="bot1")
    short = timeline(2, [1, 1], "too short to count", first=START + timedelta(days=3))
    posts = label_union({0.0: posts_of(human, "h"), 1.0: posts_of(bot + short, "b")})
    rows = {(r.user_id, r.categoria): r.asDict() for r in account_features(posts, labelled=True).collect()}
    assert set(rows) == {(1, 0.0), (1, 1.0), (2, 0.0)}
    both = expected_row(human[:6] + bot)
    for label, own in ((0.0, human[:6]), (1.0, bot)):
        alone = expected_row(own)
        row = rows[1, label]
        assert row["entropia"] == pytest.approx(alone["entropia"])
        assert row["nombre_usuario"] == alone["nombre_usuario"]
        assert row["nroTweets"] == 12
        for shared in ("avg_long_tweets", "Tuesday", "Friday", "hora_0"):
            assert row[shared] == pytest.approx(both[shared])
    assert rows[2, 0.0]["nroTweets"] == 7  # the short half is not there
    doubles = overlapping_accounts(posts).collect()
    assert {r.user_id: list(r.labels) for r in doubles} == {1: [0.0, 1.0], 2: [0.0, 1.0]}


def test_latest_profile_breaks_ties_by_post_id(posts_of):
    a, b = timeline(1, []), timeline(1, [])
    a[0]["id"], b[0]["id"] = 10, 11
    b[0]["user"]["screen_name"] = "later id"
    for rows in (a + b, b + a):
        assert latest_profile(posts_of(rows)).first().nombre_usuario == "later id"


def test_profile_features(posts_of):
    out = profile_features(posts_of(timeline(1, [])), 2.0, F.lit("2024-01-01").cast("timestamp"))
    row = out.first()
    assert row.categoria == 2.0 and row.ano_registro == 2010 and row.longitud_descripcion == 5
    assert row.cuenta_creada == datetime(2010, 5, 6, 7, 8, 9) or row.cuenta_creada.tzinfo
    assert row.createdAt is not None and len(out.columns) == 17


def test_post_features_keep_short_histories(posts_of):
    out = post_features(posts_of(timeline(4, [5, 6, 7])))
    row = out.first()
    assert row.nroTweets == 4 and row.avg_hashtags == 1.0 and row.Tuesday == 1.0


def test_unparsable_time_and_missing_account(posts_of):
    rows = timeline(1, [10, 20, 30, 40])
    rows[0]["created_at"] = "garbage"
    rows += [{**p, "user": {**p["user"], "id": None}} for p in timeline(9, [1, 2, 3, 4, 5])]
    posts = posts_of(rows)
    assert post_view(posts).count() == 5
    assert account_features(posts).count() == 0  # four dated posts are too few


def test_column_contract():
    assert len(FEATURE_COLUMNS) == 55 == len(set(FEATURE_COLUMNS))
    assert len(PREDICTION_COLUMNS) == 62 == len(set(PREDICTION_COLUMNS))


def test_legacy_time_fixture():
    assert legacy(datetime(2015, 12, 15, 0, 6, 30, tzinfo=timezone.utc)) == "Tue Dec 15 00:06:30 +0000 2015"
