"""Tables in and out: catalogue files, the shared folder, saved index tables."""
