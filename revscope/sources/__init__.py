"""Where logs, images and definitions come from."""
