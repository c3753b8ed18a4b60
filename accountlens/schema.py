"""Declared schemas and column lists of the account-classification data model."""

from __future__ import annotations

from pyspark.sql import types as T

_PROFILE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("screen_name", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("verified", T.BooleanType()),
        T.StructField("geo_enabled", T.BooleanType()),
        T.StructField("default_profile_image", T.BooleanType()),
        T.StructField("profile_use_background_image", T.BooleanType()),
        T.StructField("followers_count", T.LongType()),
        T.StructField("friends_count", T.LongType()),
        T.StructField("favourites_count", T.LongType()),
        T.StructField("listed_count", T.LongType()),
        T.StructField("statuses_count", T.LongType()),
    ]
)

_ENTITIES = T.StructType(
    [
        T.StructField(
            "urls", T.ArrayType(T.StructType([T.StructField("expanded_url", T.StringType())]))
        ),
        T.StructField(
            "hashtags", T.ArrayType(T.StructType([T.StructField("text", T.StringType())]))
        ),
        T.StructField(
            "user_mentions",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.LongType()),
                        T.StructField("screen_name", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

#: One post per JSON line. Reading with a declared schema skips the inference pass
#: over the input, and makes every source union-compatible whatever fields it lacks.
POST_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("in_reply_to_status_id", T.LongType()),
        T.StructField("entities", _ENTITIES),
        T.StructField("user", _PROFILE),
    ]
)

#: The only fields the spam detector reads; ``id`` keys the train/test split.
TEXT_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("text", T.StringType())]
)

ACCOUNT = "user_id"
LABEL = "categoria"

# --- fixed values: output names and class numbers of the data contract -------------

HUMAN, BOT, CYBORG = 0.0, 1.0, 2.0
UNLABELLED = -1.0

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
HOURS = [f"hora_{h}" for h in range(24)]
CLIENTS = ["uso_web", "uso_mobil", "uso_terceros"]

PROFILE_FEATURES = [
    "ano_registro",
    "con_descripcion",
    "con_geo_activo",
    "con_imagen_default",
    "con_imagen_fondo",
    "con_perfil_verificado",
    "entropia",
    "followers_ratio",
    "n_favoritos",
    "n_listas",
    "n_tweets",
    "reputacion",
]

POST_FEATURES = [
    "avg_diversidad_lex",
    "avg_long_tweets",
    "reply_ratio",
    "avg_hashtags",
    "mention_ratio",
    "avg_palabras",
    "avg_diversidad_palabras",
    "url_ratio",
    "avg_spam",
]

#: Input of the account classifier, in vector order (55 columns).
FEATURE_COLUMNS = [
    *PROFILE_FEATURES,
    *WEEKDAYS,
    *HOURS,
    "uso_mobil",
    "uso_terceros",
    "uso_web",
    *POST_FEATURES,
]

#: Columns of a scored account: its features, its profile stamps and the verdict.
PREDICTION_COLUMNS = [
    ACCOUNT,
    "nroTweets",
    *FEATURE_COLUMNS,
    "createdAt",
    "cuenta_creada",
    "Predicted_categoria",
    "nombre_usuario",
    "probabilidades",
]
