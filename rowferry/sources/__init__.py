"""Reading and writing tables and the four file formats."""
