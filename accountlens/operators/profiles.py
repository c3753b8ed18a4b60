"""Account attributes taken from the profile snapshot that posts carry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountlens.functions import scalars
from accountlens.operators.posts import nonempty
from accountlens.schema import ACCOUNT, LABEL, UNLABELLED

#: Snapshot fields the features need. Flags and times are reduced to numbers before
#: any shuffle; only the screen name stays text.
SNAPSHOT_FIELDS = (
    "con_imagen_fondo",
    "sec_cuenta",
    "n_favoritos",
    "con_descripcion",
    "longitud_descripcion",
    "con_perfil_verificado",
    "con_imagen_default",
    "n_listas",
    "con_geo_activo",
    "seguidores",
    "amigos",
    "n_tweets",
    "nombre_usuario",
)


def snapshot(user: str = "user") -> Column:
    """The profile fields in use, as one small struct."""
    return F.struct(
        scalars.truthy_bool(f"{user}.profile_use_background_image").alias("con_imagen_fondo"),
        scalars.epoch_seconds(scalars.parse_created_at(f"{user}.created_at")).alias("sec_cuenta"),
        F.col(f"{user}.favourites_count").alias("n_favoritos"),
        scalars.truthy_text(f"{user}.description").alias("con_descripcion"),
        F.length(f"{user}.description").alias("longitud_descripcion"),
        scalars.truthy_bool(f"{user}.verified").alias("con_perfil_verificado"),
        scalars.truthy_bool(f"{user}.default_profile_image").alias("con_imagen_default"),
        F.col(f"{user}.listed_count").alias("n_listas"),
        scalars.truthy_bool(f"{user}.geo_enabled").alias("con_geo_activo"),
        F.col(f"{user}.followers_count").alias("seguidores"),
        F.col(f"{user}.friends_count").alias("amigos"),
        F.col(f"{user}.statuses_count").alias("n_tweets"),
        F.col(f"{user}.screen_name").alias("nombre_usuario"),
    )


def latest(value: Column | str, *order: str) -> Column:
    """``value`` of the newest row by ``order``, as an aggregate.

    Unlike a ranking window it is combined on the map side, so a long timeline never
    meets in one task.
    """
    return F.max_by(value, F.struct(*order))


def latest_profile(posts: DataFrame, keys: Sequence[str] = (ACCOUNT,)) -> DataFrame:
    """Newest profile snapshot per account (ties: greatest post id)."""
    rows = (
        nonempty(posts)
        .where(F.col("user.id").isNotNull())
        .withColumn(ACCOUNT, F.col("user.id"))
        .select(
            *keys,
            "id",
            scalars.epoch_seconds(scalars.parse_created_at("created_at")).alias("sec"),
            snapshot().alias("perfil"),
        )
    )
    return rows.groupBy(*keys).agg(latest("perfil", "sec", "id").alias("perfil")).select(*keys, "perfil.*")


def profile_columns() -> dict[str, Column]:
    """Account features computed from a flattened snapshot (see :data:`SNAPSHOT_FIELDS`);
    its other fields are features as they are."""
    zero = F.lit(0)
    followers, friends = F.coalesce("seguidores", zero), F.coalesce("amigos", zero)
    return {
        "cuenta_creada": F.timestamp_seconds("sec_cuenta"),
        "reputacion": scalars.reputation(followers, friends),
        "followers_ratio": scalars.followers_ratio(followers, friends),
        "ano_registro": scalars.year_of("sec_cuenta"),
    }


def profile_features(
    posts: DataFrame, label: float = UNLABELLED, as_of: Column | None = None
) -> DataFrame:
    """Profile features of each account, its label and the processing time.

    The gap entropy is the one account feature that needs the whole timeline;
    :func:`accountlens.plans.features.account_features` joins it in.
    """
    computed = {
        **profile_columns(),
        LABEL: F.lit(label),
        "createdAt": F.current_timestamp() if as_of is None else as_of,
    }
    return latest_profile(posts).withColumns(computed).drop("sec_cuenta", "seguidores", "amigos")
