"""Column expressions: everything here runs in the JVM and works alike in batch and streaming plans."""
