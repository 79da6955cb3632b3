"""Reading and writing the tables and files the library works on."""
