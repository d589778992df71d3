"""Entity maps, reading, shaping and saving of tables."""
