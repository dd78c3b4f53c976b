"""Reading and writing files of bytes."""
