import json
import os
import sys
from datetime import datetime, timedelta, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from accountlens.session import build_session  # noqa: E402

START = datetime(2015, 12, 15, 0, 6, 30, tzinfo=timezone.utc)


def legacy(t: datetime) -> str:
    return t.strftime("%a %b %d %H:%M:%S +0000 %Y")


def timeline(account, gaps, text="Hello  world", source="web", first=START, **user):
    """Posts of one account, newest first, ``gaps`` seconds apart."""
    profile = {
        "id": account,
        "screen_name": f"user{account}",
        "created_at": legacy(datetime(2010, 5, 6, 7, 8, 9, tzinfo=timezone.utc)),
        "description": "about",
        "verified": False,
        "geo_enabled": True,
        "default_profile_image": False,
        "profile_use_background_image": True,
        "followers_count": 30,
        "friends_count": 10,
        "favourites_count": 5,
        "listed_count": 2,
        "statuses_count": 100,
        **user,
    }
    times = [first]
    for gap in gaps:
        times.append(times[-1] + timedelta(seconds=gap))
    rows = [
        {
            "id": account * 100_000 + i,
            "created_at": legacy(t),
            "text": text if isinstance(text, str) else text[i % len(text)],
            "source": source if isinstance(source, str) else source[i % len(source)],
            "in_reply_to_status_id": None,
            "entities": {"urls": [], "hashtags": [{"text": "x", "indices": [0, 2]}], "user_mentions": []},
            "user": dict(profile),
            "lang": "en",
        }
        for i, t in enumerate(times)
    ]
    return rows[::-1]


def write_lines(path, posts):
    os.makedirs(os.path.dirname(str(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(p, ensure_ascii=False) + "\n" for p in posts)
    return str(path)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.sql.debug.maxToStringFields": "1000",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def posts_of(spark, tmp_path):
    """Posts written as a JSON-lines file and read back."""
    from accountlens.sources.posts import read_posts

    def load(rows, name="posts"):
        return read_posts(spark, write_lines(tmp_path / name, rows))

    return load
