"""Reading feeds and the tables of a warehouse folder."""
