"""Reading, typing and generating the star schema."""
