"""Pure DataFrame operators: frames in, one lazy frame out."""
