"""Rolling form, adjusted expectations and threshold reports on Spark."""

from formbook.plans.form import FormSettings, build_games, game_sides, run, with_dotted_names
from formbook.sources.tables import FormTables, read_tables, season_range

__all__ = [
    "FormSettings",
    "FormTables",
    "build_games",
    "game_sides",
    "read_tables",
    "run",
    "season_range",
    "with_dotted_names",
]
