"""Training-data operators (texts, vectors, archives, host graphs). Nothing outside this folder imports it."""
