"""File-stream ingestion and refresh jobs."""
