"""Landing folders of scenes as a stream."""
