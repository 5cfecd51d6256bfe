"""Nothing here: a namespace snapshot is one complete, bounded input, and none of the
supported reports has a streaming form."""
