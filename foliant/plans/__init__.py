"""Plans built from small descriptions: the scan algebra."""
