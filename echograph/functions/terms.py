"""Keyword lists of the published runs.  Fixed values: results depend on them."""

# Fixed values, intake of whole days.
INTAKE_TERMS = [
    "nintendo",
    "pokemon",
    "video game",
    "game",
    "pokémon legends: arceus",
    "pokémon",
    "legend of arceus",
    "legend arceus",
    "legends of arceus",
    "pokemon legends: arceus",
    "stream",
    "twitch",
    "arceus",
]

# Fixed values, wider topic list for the interaction graph.
BROAD_TOPIC_TERMS = [
    "nintendo",
    "pokemon",
    "pokémon legends: arceus",
    "pokémon",
    "legend of arceus",
    "legend arceus",
    "legends of arceus",
    "pokemon legends: arceus",
    "arceus",
]

# Fixed values, narrow topic list for hubs and authorities.
TOPIC_TERMS = [
    "pokémon legends: arceus",
    "legend of arceus",
    "legend arceus",
    "legends of arceus",
    "pokemon legends: arceus",
    "arceus",
]
