"""End-to-end plans over scenes."""
